"""System and network logs of many programs and kinds, rendered from the test events and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..sources import logs as L
from ..sources import zeek as Z
from . import query
from .sources import ID, IP, IPX, K, SEC, USER, _flat, _lines


#: Log lines by event id modulo their number: (program, parts of the text, event, description, attributes as SQL).
SYSLOG_LINES = (
    ("sshd", ["Accepted publickey for ", USER, " from ", IP, " port 22 ssh2: ED25519 SHA256:abc", K], "ssh_login", "SSH Login Time", {"user": "a_user", "src_ip": IPX, "key_fingerprint": "'SHA256:abc' || a_k"}),
    ("sshd", ["Failed password for invalid user ", USER, " from ", IP, " port 22"], "ssh_failed", "SSH Login Failed Time", {"user": "a_user", "src_ip": IPX, "invalid_user": "'true'"}),
    ("sshd", ["Failed none for ", USER, " from ", IP, " port 22"], "ssh_failed", "SSH Login Failed Time", {"user": "a_user", "src_ip": IPX}),
    ("sshd", ["Received disconnect from ", IP, " port 22:11: bye"], "ssh_disconnect", "SSH Disconnect Time", {"src_ip": IPX}),
    ("su", ["Successful su for root by ", USER], "su", "Su Success Time", {"user": "a_user", "target_user": "'root'"}),
    ("su-l", ["FAILED su for root by ", USER], "su_failed", "Su Failed Time", {"user": "a_user", "target_user": "'root'"}),
    ("crond", ["(", USER, ") CMD (run ", K, ")"], "cron_command", "Cron Command Time", {"user": "a_user", "command": "'run ' || a_k"}),
    ("sudo", ["pam_unix(sudo:session): session opened for user ", USER, "(uid=", K, ") by (uid=0)"], "session_opened", "Session Opened Time", {"user": "a_user"}),
    ("sudo", [USER, " : TTY=pts/1 ; PWD=/ ; USER=root ; COMMAND=/bin/ls ", K], "sudo_command", "Sudo Command Time", {"user": "a_user", "target_user": "'root'", "tty": "'pts/1'", "command": "'/bin/ls ' || a_k"}),
    ("useradd", ["new group: name=g", K, ", GID=7"], "group_added", "Group Created Time", {"group": "'g' || a_k", "gid": "'7'"}),
    ("passwd", ["password for '", USER, "' changed by root"], "password_changed", "Password Changed Time", {"user": "a_user"}),
    ("kernel", ["refused 999.1.1.1 then ", IP, " by rule ", K], "", "Log Entry", {"src_ip": IPX}),
)
SYSLOG_KEYS = ("event", "user", "src_ip", "key_fingerprint", "invalid_user", "target_user", "command", "tty", "group", "gid")


def _by_rest(values: list[str]) -> str:
    """SQL that takes the value of the row's line."""
    return f"CASE n % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _syslog_sql() -> str:
    value = {k: [attributes.get(k, "''") for *_, attributes in SYSLOG_LINES] for k in SYSLOG_KEYS}
    value["event"] = [f"'{event}'" for _, _, event, _, _ in SYSLOG_LINES]
    columns = ", ".join(f'{_by_rest(v)} AS "{k}"' for k, v in value.items())
    artifact = _by_rest([f"'syslog:{program}'" for program, *_ in SYSLOG_LINES])
    desc = _by_rest([f"'{d}'" for *_, d, _ in SYSLOG_LINES])
    rows = "SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL"
    return f"SELECT event_id, {SEC} AS ms, {artifact} AS artifact, {desc} AS timestamp_desc, {columns} FROM ({rows})"


@query("src_syslog_programs", X.sql(_syslog_sql()))
def src_syslog_programs(spark, sf):
    """A line of every program in turn, behind three forms of header, with and without a priority."""
    kinds, text = len(SYSLOG_LINES), F.lit("")
    for i, (program, parts, *_) in enumerate(SYSLOG_LINES):
        said = F.concat(*[F.lit(p) if isinstance(p, str) else p() for p in parts])
        text = F.when(ID() % kinds == i, F.concat(F.lit(f"{program}[7]: "), said)).otherwise(text)
    bsd = F.concat(F.lit("<38>"), F.date_format("timestamp", "MMM d HH:mm:ss"))
    spaced = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    offset = F.concat(F.date_format(F.col("timestamp") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200"))
    head = F.when(ID() % 5 < 2, bsd).when(ID() % 5 == 2, spaced).otherwise(offset)
    out = L.syslog(_lines(spark, sf, F.concat(head, F.lit("  host1 "), text)), 2024).where("ok")
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "artifact", "timestamp_desc", *_flat(*SYSLOG_KEYS))


FLOW = f"{IPX} || ':40 -> 10.9.9.9:80'"
#: Parts of one file in the order of event ids: (kind, fields after time and flow, their values, event, description, message as SQL).
ZEEK_PARTS = (
    ("conn", ("proto", "service", "orig_bytes", "resp_bytes"), ["tcp", "http", K, "-"], "connection", "Connection Time", f"'tcp ' || {FLOW} || ' http ' || a_k || '/0 bytes'"),
    ("dns", ("query", "qtype_name", "answers"), ["q.example", "A", IP], "query", "DNS Query Time", f"'dns A q.example -> ' || {IPX}"),
    ("http", ("method", "host", "uri", "status_code"), ["GET", "h.example", K, "200"], "request", "HTTP Request Time", "'GET h.example' || a_k || ' 200'"),
    ("smtp", ("mailfrom", "rcptto", "subject"), [USER, "b@x", "-"], "message", "SMTP Message Time", "'mail from ' || a_user || ' to b@x'"),
    ("ftp", ("command", "arg"), ["RETR", K], "session", "FTP Session Time", f"'ftp RETR ' || a_k || ' ' || {FLOW}"),
    ("dhcp", ("mac", "assigned_addr"), ["aa:bb", IP], "lease", "DHCP Lease Time", f"'dhcp aa:bb got ' || {IPX}"),
    ("software", ("name", "version.major", "version.addl", "host"), ["curl", K, "(empty)", IP], "software", "Software Seen Time", f"'software curl ' || a_k || ' on ' || {IPX}"),
    ("custom", ("uid",), [K], "log", "Zeek custom Time", f"'custom ' || {FLOW}"),
)
#: Events of one part, and bytes between two lines.
PART, STEP = 1000, 100


def _zeek_sql() -> str:
    pick = lambda values: "CASE p " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    artifact, event = pick([f"'zeek:{k}'" for k, *_ in ZEEK_PARTS]), pick([f"'{p[3]}'" for p in ZEEK_PARTS])
    desc, text = pick([f"'{p[4]}'" for p in ZEEK_PARTS]), pick([p[5] for p in ZEEK_PARTS])
    url = pick([f"'h.example' || a_k" if k == "http" else "''" for k, *_ in ZEEK_PARTS])
    ms = f"CASE WHEN n % 10 = 0 THEN 1704103200000 + p * 1000 ELSE {SEC} END"
    rows = f"SELECT *, CAST(event_id AS BIGINT) AS n, CAST(event_id AS BIGINT) // {PART} % {len(ZEEK_PARTS)} AS p FROM ev WHERE ms IS NOT NULL AND CAST(event_id AS BIGINT) % 17 <> 3"
    return f"SELECT event_id, {ms} AS ms, {artifact} AS artifact, {desc} AS timestamp_desc, {event} AS event, {IPX} AS src_ip, '40' AS src_port, {url} AS url, {text} AS message FROM ({rows})"


@query("src_zeek_kinds", X.sql(_zeek_sql()))
def src_zeek_kinds(spark, sf):
    """A file whose kind, fields and separator change every 1,000 events; every tenth line has no time, some have none that is a number."""
    kinds, n = len(ZEEK_PARTS), ID()
    time = F.when(n % 17 == 3, "soon").when(n % 10 == 0, "-").otherwise(F.floor(F.unix_millis("timestamp") / 1000).cast("string"))
    flow = [IP(), F.lit("40"), F.lit("10.9.9.9"), F.lit("80")]
    raw = F.lit("")
    for i, (_, _, values, *_) in enumerate(ZEEK_PARTS):
        own = [F.lit(v) if isinstance(v, str) else v() for v in values]
        raw = F.when(F.floor(n / PART) % kinds == i, F.concat_ws("\t" if i % 2 else "|", time, *flow, *own)).otherwise(raw)
    lines = _lines(spark, sf, raw).select("event_id", "raw", ((n + 1) * STEP).alias("byte_offset"))

    # Each part's headers stand before its first line, made from the parts that occur.
    part = F.floor(n / PART)
    parts = X.events(spark, sf).select(part.alias("part")).distinct()
    heads = F.lit(None).cast("array<string>")
    for i, (kind, fields, *_) in enumerate(ZEEK_PARTS):
        sep, code = ("\t", "\\x09") if i % 2 else ("|", "\\x7c")
        names = sep.join(["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", *fields])
        said = [f"#separator {code}", f"#path{sep}{kind}", f"#open{sep}2024-01-01-10-00-{i:02d}", f"#fields{sep}{names}"]
        heads = F.when(F.col("part") % kinds == i, F.array(*map(F.lit, said))).otherwise(heads)
    head = parts.select("part", F.posexplode(heads).alias("at", "raw"))
    head = head.select(F.lit("").alias("event_id"), "raw", ((F.col("part") * PART * STEP) + 10 + F.col("at")).alias("byte_offset"))
    out = Z.zeek(lines.unionByName(head).withColumn("source_file", F.lit("logs/all.log"))).where("ok")
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "artifact", "timestamp_desc", *_flat("event", "src_ip", "src_port", "url"), "message")
