"""Log families: nginx, Apache, firewall, Suricata, syslog, honeypots, journal, CloudTrail, Windows events.

Each parser takes lines (raw and any other columns) and returns them with the event columns and `ok`, which
is false for lines of another form. All patterns are built-in regular expressions on whole columns.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import IPV4, clean_attributes, json_map, last_key_wins
from .text import attributes_of


def _x(pattern: str, i: int, column: str = "raw") -> Column:
    return F.regexp_extract(column, pattern, i)


def event_rows(lines: DataFrame, ok: Column, ts: Column, message: Column, artifact, attributes: Column, desc: str | Column = "Log Entry", tags: Column | None = None) -> DataFrame:
    """lines with the columns of an event, and ok."""
    artifact = F.lit(artifact) if isinstance(artifact, str) else artifact
    return last_key_wins(lines).withColumns({"ok": F.coalesce(ok, F.lit(False)), "timestamp": ts, "timestamp_desc": F.lit(desc) if isinstance(desc, str) else desc, "message": message, "artifact": artifact, "artifact_long": F.lit(""), "display_name": F.lit(""), "tags": tags if tags is not None else F.array().cast("array<string>"), "attributes": attributes})


def _blank(c: Column) -> Column:
    return F.when(c.isin("-", ""), F.lit(None)).otherwise(c)


COMBINED = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "((?:[^"\\]|\\.)*)" (\d{3}) (\d+|-)(?: "((?:[^"\\]|\\.)*)" "((?:[^"\\]|\\.)*)")?'
REQUEST = r"^([A-Z]+) (\S+)(?: (\S+))?$"
CLF_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


#: Stands between the groups of a match; no text log holds it.
CUT = "\x1f\x1e"


def _groups(pattern: str, column: str = "raw") -> Column:
    """All groups of an anchored pattern as an array, from one match; null for other lines. Groups without text are empty."""
    n = re.compile(pattern).groups
    parts = F.split(F.regexp_replace(column, f"(?s){pattern}.*", CUT.join(f"${i}" for i in range(1, n + 1))), CUT)
    return F.get(F.filter(F.array(parts), lambda p: F.size(p) == n), 0)


def _parts(column: str):
    return lambda i: F.get(F.col(column), i - 1)


def _access(column: str, artifact: str, shift: int = 0) -> tuple[Column, ...]:
    """(timestamp, message, artifact, attributes, description) of an access line's groups."""
    g = _parts(column)
    at = lambda i: g(i + shift)
    request = at(5)
    part = lambda i: F.regexp_extract(request, REQUEST, i)
    attributes = attributes_of(src_ip=at(1), user=_blank(at(3)), method=part(1), uri=F.coalesce(F.nullif(part(2), F.lit("")), request), protocol=part(3), status=at(6), size=_blank(at(7)), referer=_blank(at(8)), user_agent=_blank(at(9)), **({"vhost": g(1)} if shift else {}))
    return F.try_to_timestamp(at(4), F.lit(CLF_TIME)), F.concat_ws(" ", request, at(6)), F.lit(artifact), attributes, F.lit("Request Time")


def _first_of(lines: DataFrame, forms: list[tuple[str, str, tuple[Column, ...]]]) -> DataFrame:
    """Events of lines in the first of several forms that fits: (column of its groups, pattern, columns); one pass, later patterns are tried on the rest only."""
    for i, (column, pattern, _) in enumerate(forms):
        before = [F.col(c).isNotNull() for c, _, _ in forms[:i]]
        lines = lines.withColumn(column, F.when(~reduce(or_, before), _groups(pattern)) if before else _groups(pattern))

    def pick(i: int, other: Column) -> Column:
        for column, _, columns in reversed(forms):
            other = F.when(F.col(column).isNotNull(), columns[i]).otherwise(other)
        return other

    ok = reduce(or_, [F.col(c).isNotNull() for c, _, _ in forms])
    none = (F.lit(None).cast("timestamp"), F.col("raw"), F.lit(""), F.create_map().cast("map<string,string>"), F.lit("Log Entry"))
    out = event_rows(lines, ok, *[pick(i, x) for i, x in enumerate(none)])
    return out.drop(*[c for c, _, _ in forms])


def nginx_access(lines: DataFrame) -> DataFrame:
    return _first_of(lines, [("_a", COMBINED, _access("_a", "nginx:access"))])


NGINX_ERROR = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#(\d+): (?:\*(\d+) )?(.*)$"


def _nginx_error(column: str) -> tuple[Column, ...]:
    g = _parts(column)
    attributes = attributes_of(level=g(2), pid=g(3), tid=g(4), connection=g(5), src_ip=F.regexp_extract(g(6), r"client: ([0-9a-fA-F.:]+)", 1))
    return F.try_to_timestamp(g(1), F.lit("yyyy/MM/dd HH:mm:ss")), g(6), F.lit("nginx:error"), attributes, F.lit("Log Entry")


def nginx_error(lines: DataFrame) -> DataFrame:
    return _first_of(lines, [("_e", NGINX_ERROR, _nginx_error("_e"))])


def nginx(lines: DataFrame) -> DataFrame:
    """Access and error lines of one file."""
    return _first_of(lines, [("_a", COMBINED, _access("_a", "nginx:access")), ("_e", NGINX_ERROR, _nginx_error("_e"))])


VHOST = r'^(\S+?)(?::\d+)? (\S+) (\S+) (\S+) \[([^\]]+)\] "((?:[^"\\]|\\.)*)" (\d{3}) (\d+|-)(?: "((?:[^"\\]|\\.)*)" "((?:[^"\\]|\\.)*)")?'
APACHE_24 = r"^\[([A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)? \d{4})\] \[(?:([\w-]*):)?(\w+)\] \[pid (\d+)(?::tid (\d+))?\] (?:\[client ([^\]]+)\] )?(?:(AH\d+): )?(.*)$"
APACHE_22 = r"^\[([A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} \d{4})\] \[(\w+)\] (?:\[client ([^\]]+)\] )?(.*)$"


def apache(lines: DataFrame) -> DataFrame:
    """Access lines with or without a virtual host, error lines of both versions."""
    time = lambda c: F.coalesce(*[F.try_to_timestamp(F.regexp_replace(c, r"^\w+ ", ""), F.lit(f"MMM dd HH:mm:ss{f} yyyy")) for f in (".SSSSSS", "")])
    client = lambda c: {"src_ip": F.regexp_replace(c, r":\d+$", ""), "src_port": F.regexp_extract(c, r"\.\d+:(\d+)$", 1)}
    n, o = _parts("_e24"), _parts("_e22")
    e24 = time(n(1)), n(8), F.lit("apache:error"), attributes_of(module=n(2), level=n(3), pid=n(4), tid=n(5), code=n(7), **client(n(6))), F.lit("Log Entry")
    e22 = time(o(1)), o(4), F.lit("apache:error"), attributes_of(level=o(2), **client(o(3))), F.lit("Log Entry")
    return _first_of(lines, [("_plain", COMBINED, _access("_plain", "apache:access")), ("_vhost", VHOST, _access("_vhost", "apache:access", 1)), ("_e24", APACHE_24, e24), ("_e22", APACHE_22, e22)])


#: Both headers may stand behind a priority in angle brackets.
SYSLOG_REST = r"\s+(\S+)\s+([^\s:\[]+)(?:\[(\d+)\])?:\s?(.*)$"
SYSLOG_BSD = r"^(?:<\d+>\s*)?([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})" + SYSLOG_REST
SYSLOG_ISO = r"^(?:<\d+>\s*)?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*)" + SYSLOG_REST


def syslog_header(lines: DataFrame, year: int | None) -> DataFrame:
    """lines with _ts, _host, _program, _pid, _text and _ok of both header forms; times without a year get the given one, or are undated."""
    rows = lines.withColumn("_iso", _groups(SYSLOG_ISO))
    rows = rows.withColumn("_head", F.coalesce("_iso", _groups(SYSLOG_BSD)))
    g = _parts("_head")
    bsd = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(g(1), r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss")) if year else F.lit(None).cast("timestamp")
    # Fractions beyond microseconds are cut off, and hours and minutes of an offset may stand without a colon.
    iso = F.regexp_replace(F.regexp_replace(g(1), r"(\.\d{6})\d+", "$1"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    ts = F.when(F.col("_iso").isNotNull(), iso.try_cast("timestamp")).otherwise(bsd)
    texts = {f"_{k}": F.coalesce(g(i), F.lit("")) for i, k in enumerate(("host", "program", "pid", "text"), 2)}
    return rows.withColumns({"_ts": ts, "_ok": F.col("_head").isNotNull(), **texts}).drop("_iso", "_head")


SYSLOG_COLUMNS = ("_ts", "_host", "_program", "_pid", "_text", "_ok")

#: (programs in lower case or () for any, pattern, event, what its time means, names of the groups); the first that fits counts.
SYSLOG_RULES = (
    (
        ("sshd",),
        r"^Accepted (\S+) for (\S+) from (\S+) port (\d+)(?:.*?(SHA256:\S+))?",
        "ssh_login",
        "SSH Login Time",
        ("method", "user", "src_ip", "src_port", "key_fingerprint"),
    ),
    (
        ("sshd",),
        r"^Failed (\S+) for (invalid user )?(\S+) from (\S+) port (\d+)",
        "ssh_failed",
        "SSH Login Failed Time",
        ("method", "invalid_user", "user", "src_ip", "src_port"),
    ),
    (("sshd",), r"^Invalid user (\S*) from (\S+)(?: port (\d+))?", "ssh_invalid_user", "SSH Invalid User Time", ("user", "src_ip", "src_port")),
    (
        ("sshd",),
        r"^(?:Disconnected|Received disconnect) from (?:authenticating |invalid )?(?:user (\S+) )?(\S+) port (\d+)",
        "ssh_disconnect",
        "SSH Disconnect Time",
        ("user", "src_ip", "src_port"),
    ),
    (
        ("sshd",),
        r"^Connection closed by (?:authenticating |invalid )?(?:user (\S+) )?(\S+) port (\d+)",
        "ssh_closed",
        "SSH Disconnect Time",
        ("user", "src_ip", "src_port"),
    ),
    # Refused commands are written behind the reason, so these come before the commands.
    (("sudo",), r"^\s*(\S+) : (?:\d+ incorrect password attempts?|user NOT in sudoers)", "sudo_failed", "Sudo Auth Failure Time", ("user",)),
    (
        ("sudo",),
        r"^\s*(\S+) : (?:.*?TTY=(\S+) ; )?.*?PWD=(.*?) ; USER=(\S+) ; COMMAND=(.*)$",
        "sudo_command",
        "Sudo Command Time",
        ("user", "tty", "cwd", "target_user", "command"),
    ),
    (("sudo",), r"authentication failure;.* user=(\S+)", "sudo_failed", "Sudo Auth Failure Time", ("user",)),
    (("sudo",), r"authentication failure", "sudo_failed", "Sudo Auth Failure Time", ()),
    (("su", "su-l"), r"^\(to ([^)]+)\) (\S+) on", "su", "Su Success Time", ("target_user", "user")),
    (("su", "su-l"), r"^Successful su for (\S+) by (\S+)", "su", "Su Success Time", ("target_user", "user")),
    (("su", "su-l"), r"^FAILED SU \(to ([^)]+)\) (\S+) on", "su_failed", "Su Failed Time", ("target_user", "user")),
    (("su", "su-l"), r"^FAILED [sS][uU](?: for (\S+))?(?: by (\S+))?", "su_failed", "Su Failed Time", ("target_user", "user")),
    (("cron", "crond"), r"^\(([^)]+)\) CMD \((.*)\)\s*$", "cron_command", "Cron Command Time", ("user", "command")),
    (("systemd-logind",), r"^New session (\S+) of user (\S+)\.", "session_start", "Login Session Start Time", ("session", "user")),
    (("systemd-logind",), r"^Removed session (\S+)\.", "session_end", "Login Session End Time", ("session",)),
    (("useradd",), r"^new user: name=([^,]+), UID=(\d+)", "user_added", "User Created Time", ("user", "uid")),
    (("useradd", "groupadd"), r"^new group: name=([^,]+)(?:, GID=(\d+))?", "group_added", "Group Created Time", ("group", "gid")),
    (("userdel",), r"^delete user '([^']+)'", "user_deleted", "User Deleted Time", ("user",)),
    (("userdel", "groupdel"), r"^(?:removed )?group '([^']+)'(?: removed)?", "group_deleted", "Group Deleted Time", ("group",)),
    (("usermod", "chage"), r"^(?:change user|add|changed password expiry for) '?([^'\s]+)'?", "user_changed", "User Modified Time", ("user",)),
    (("passwd",), r"password changed for (\S+)", "password_changed", "Password Changed Time", ("user",)),
    (("passwd",), r"^password for '?([^'\s]+)'? changed", "password_changed", "Password Changed Time", ("user",)),
    (("systemd",), r"^(Started|Stopped) (.+?)\.?$", "service", "Log Entry", ("state", "service")),
    # Any program's session lines.
    ((), r"session opened for user ([^\s(]+)", "session_opened", "Session Opened Time", ("user",)),
    ((), r"session closed for user ([^\s(]+)", "session_closed", "Session Closed Time", ("user",)),
)
#: Stand between the pairs, and between name and value, of what a rule has found; texts are cleared of them first.
PAIR, NAMED = "\x1e", "\x1f"


def _syslog_rule(pattern: str, event: str, desc: str, groups: tuple[str, ...]) -> Column:
    """What a rule finds in a text that it fits, as one text of named values."""
    named = [("event", event), ("time", desc), *[(n, f"${i}") for i, n in enumerate(groups, 1)]]
    around = f"(?s){pattern}.*" if pattern.startswith("^") else f"(?s)^.*?{pattern}.*"
    return F.regexp_replace("_said", around, PAIR.join(f"{n}{NAMED}{v}" for n, v in named))


def syslog(lines: DataFrame, year: int | None = None) -> DataFrame:
    """BSD and ISO headers; known programs' messages by one chain of rules, others with the first address of their text.

    The rule that fits gives one text of named values, which becomes the attributes as a whole. The column ok is false
    for lines without a header, null ones too.
    """
    rows = syslog_header(lines, year).withColumn("_said", F.translate("_text", PAIR + NAMED, "  "))
    program, found = F.lower("_program"), []
    for programs, pattern, event, desc, groups in SYSLOG_RULES:
        fits = F.col("_said").rlike(pattern)
        found.append(F.when(program.isin(*programs) & fits if programs else fits, _syslog_rule(pattern, event, desc, groups)))
    rows = rows.withColumn("_rule", F.str_to_map(F.coalesce(*found), F.lit(PAIR), F.lit(NAMED)))
    # The words before a name say that the user is none of the system's.
    value = lambda k, v: F.when(k == "invalid_user", F.when(v != "", "true")).otherwise(v)
    named = clean_attributes(F.transform_values("_rule", value))
    own = F.coalesce(F.map_filter(named, lambda k, v: k != "time"), attributes_of(src_ip=_first_address(F.col("_said"))))
    common = attributes_of(host=F.col("_host"), program=F.col("_program"), pid=F.col("_pid"))
    desc = F.coalesce(F.col("_rule")["time"], F.lit("Log Entry"))
    out = event_rows(rows, F.col("_ok"), F.col("_ts"), F.col("_text"), F.concat(F.lit("syslog:"), F.col("_program")), F.map_concat(common, own), desc)
    return out.drop("_rule", "_said", *SYSLOG_COLUMNS)


def _first_address(text: Column) -> Column:
    """The first IPv4 address of a text, or ''."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d.])((?:\d{1,3}\.){3}\d{1,3})(?![\d.]*\d)"), F.lit(1))
    return F.coalesce(F.get(F.filter(found, lambda a: a.rlike(IPV4)), 0), F.lit(""))


#: Positions of a firewall line's fields after the header, by IP version and protocol.
FILTER_HEAD = ("rule", "sub_rule", "anchor", "tracker", "interface", "reason", "action", "direction", "ip_version")
FILTER_V4 = ("tos", "ecn", "ttl", "id", "offset", "flags", "protocol_id", "protocol", "length", "src_ip", "dst_ip")
FILTER_V6 = ("class", "flow_label", "hop_limit", "protocol", "protocol_id", "length", "src_ip", "dst_ip")
FILTER_TAIL = {"tcp": ("src_port", "dst_port", "data_length", "tcp_flags", "sequence", "ack", "window", "urg", "options"), "udp": ("src_port", "dst_port", "data_length"), "icmp": ("icmp_type", "icmp_id", "icmp_sequence")}


def filterlog(lines: DataFrame, year: int | None = None) -> DataFrame:
    """Packet-filter CSV behind a syslog header, positional by IP version and protocol."""
    rows = syslog_header(lines, year).withColumn("_p", F.split("_text", ","))
    at = lambda i: F.get("_p", i)
    v4, v6, n = at(8) == "4", at(8) == "6", len(FILTER_HEAD)
    names: dict[str, Column] = {k: at(i) for i, k in enumerate(FILTER_HEAD)}
    for k in sorted({*FILTER_V4, *FILTER_V6}):
        a = at(n + FILTER_V4.index(k)) if k in FILTER_V4 else F.lit(None).cast("string")
        b = at(n + FILTER_V6.index(k)) if k in FILTER_V6 else F.lit(None).cast("string")
        names[k] = F.when(v4, a).when(v6, b)
    protocol = F.lower(names["protocol"])
    base = F.when(v4, n + len(FILTER_V4)).otherwise(n + len(FILTER_V6))
    for k in sorted({x for t in FILTER_TAIL.values() for x in t}):
        value = F.lit(None).cast("string")
        for proto, tail in FILTER_TAIL.items():
            if k in tail:
                value = F.when(protocol.startswith(proto), F.get("_p", base + tail.index(k))).otherwise(value)
        names[k] = value
    ok = F.col("_ok") & (F.col("_program") == "filterlog") & (v4 | v6) & (F.size("_p") >= n + 8)
    port = lambda ip, p: F.concat_ws(":", names[ip], names[p])
    message = F.concat_ws(" ", names["action"], names["direction"], F.lit("on"), names["interface"], protocol, port("src_ip", "src_port"), F.lit("->"), port("dst_ip", "dst_port"))
    out = event_rows(rows, ok, F.col("_ts"), message, F.concat(F.lit("firewall:filterlog:"), names["action"]), attributes_of(**names))
    return out.drop("_p", *SYSLOG_COLUMNS)


#: Levels of nested objects that are flattened; objects below stay JSON text.
LEVELS = 5


def flat_json(raw: Column, levels: int = LEVELS) -> Column:
    """A JSON object's values as text, nested objects as dotted keys, blanks and nulls left out."""
    out = F.map_entries(json_map(raw))
    inner = lambda e: F.transform(F.map_entries(json_map(e["value"])), lambda i: F.struct(F.concat_ws(".", e["key"], i["key"]).alias("key"), i["value"].alias("value")))
    for _ in range(levels):
        out = F.flatten(F.transform(out, lambda e: F.when(e["value"].startswith("{"), F.coalesce(inner(e), F.array(e))).otherwise(F.array(e))))
    return F.map_from_entries(F.filter(out, lambda p: p["value"].isNotNull() & (p["value"] != "") & (p["value"] != "null")))


FAST = r"^(\d{2}/\d{2}/\d{4}-\d{2}:\d{2}:\d{2}\.\d+)\s+\[\*\*\] \[(\d+):(\d+):(\d+)\] (.*?) \[\*\*\] (?:\[Classification: ([^\]]*)\] )?\[Priority: (\d+)\] \{(\w+)\} (\S+?)(?::(\d+))? -> (\S+?)(?::(\d+))?$"
PROMOTED = {"src_ip": "src_ip", "src_port": "src_port", "dest_ip": "dst_ip", "dest_port": "dst_port", "proto": "protocol", "event_type": "event_type"}


def suricata(lines: DataFrame) -> DataFrame:
    """EVE JSON, fast.log lines and tabbed syslog, told apart by line."""
    body = F.when(F.col("raw").contains("\t"), F.element_at(F.split("raw", "\t"), -1)).otherwise(F.col("raw"))
    rows = last_key_wins(lines).withColumn("_body", F.trim(body)).withColumn("_m", F.when(F.col("_body").startswith("{"), flat_json(F.col("_body"))))
    m, kind = (lambda k: F.col("_m")[k]), F.col("_m")["event_type"]
    rows = rows.withColumn("_f", F.when(kind.isNull(), _groups(FAST, "_body")))
    g, is_eve, is_fast = _parts("_f"), kind.isNotNull(), F.col("_f").isNotNull()
    alert, http, dns = F.concat(F.lit("alert: "), F.coalesce(m("alert.signature"), F.lit(""))), F.concat_ws(" ", m("http.http_method"), F.concat(F.coalesce(m("http.hostname"), F.lit("")), F.coalesce(m("http.url"), F.lit("")))), F.concat_ws(" ", F.lit("dns"), m("dns.type"), m("dns.rrname"))
    text = F.when(kind == "alert", alert).when(kind == "http", http).when(kind == "dns", dns).otherwise(F.concat_ws(" ", kind, m("src_ip"), F.lit("->"), m("dest_ip")))
    own = F.map_concat(F.map_filter("_m", lambda k, v: ~k.isin("timestamp", *PROMOTED)), attributes_of(**{v: m(k) for k, v in PROMOTED.items()}))
    fast = attributes_of(gid=g(2), sid=g(3), rev=g(4), signature=g(5), classification=g(6), priority=g(7), protocol=g(8), src_ip=g(9), src_port=g(10), dst_ip=g(11), dst_port=g(12))
    eve_time = F.date_trunc("millisecond", F.regexp_replace(m("timestamp"), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    pick = lambda eve, other, none: F.when(is_eve, eve).when(is_fast, other).otherwise(none)
    ts = pick(eve_time, F.try_to_timestamp(g(1), F.lit("MM/dd/yyyy-HH:mm:ss.SSSSSS")), F.lit(None).cast("timestamp"))
    artifact = pick(F.concat(F.lit("suricata:"), kind), F.lit("suricata:alert"), F.lit(""))
    out = event_rows(rows, is_eve | is_fast, ts, pick(text, F.concat(F.lit("alert: "), g(5)), F.col("raw")), artifact, pick(own, fast, F.create_map().cast("map<string,string>")))
    return out.drop("_body", "_m", "_f")


def cloudtrail_lines(files: DataFrame) -> DataFrame:
    """Texts (value) that are {"Records": [...]}: promoted scalars, nested objects as dotted keys, a message from the identity."""
    lines = files.select(*[c for c in files.columns if c != "value"], F.explode(F.from_json(F.get_json_object("value", "$.Records"), "array<string>")).alias("raw"))
    rows = lines.withColumn("_m", flat_json(F.col("raw")))
    m = lambda k: F.col("_m")[k]
    who = F.coalesce(m("userIdentity.userName"), m("userIdentity.arn"), m("userIdentity.invokedBy"), m("userIdentity.type"), F.lit("?"))
    address = F.when(m("sourceIPAddress").rlike(IPV4) | m("sourceIPAddress").contains(":"), m("sourceIPAddress"))
    out = event_rows(rows, m("eventName").isNotNull(), m("eventTime").try_cast("timestamp"), F.concat_ws(" ", who, m("eventName"), F.lit("on"), m("eventSource")), "cloudtrail", F.map_concat(F.map_filter("_m", lambda k, v: k != "eventTime"), attributes_of(src_ip=address, user=who)), "Event Time")
    return out.drop("_m")


def cloudtrail(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder, each one JSON text; digest files are skipped."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return cloudtrail_lines(files.select(F.col("_metadata.file_path").alias("source_file"), "value").where("source_file NOT LIKE '%CloudTrail-Digest%'"))


def cowrie(lines: DataFrame) -> DataFrame:
    """Honeypot JSON with eventid and timestamp; one level flattened."""
    rows = lines.withColumn("_m", flat_json(F.col("raw"), 1))
    m = lambda k: F.col("_m")[k]
    text = F.coalesce(m("message"), F.when(m("eventid") == "cowrie.command.input", F.concat_ws(" ", F.lit("command:"), m("input"))), F.when(m("eventid").startswith("cowrie.login"), F.concat_ws(" ", F.lit("login"), m("username"), m("password"))), m("eventid"))
    ok = m("eventid").isNotNull() & m("timestamp").isNotNull()
    return event_rows(rows, ok, F.date_trunc("millisecond", m("timestamp").try_cast("timestamp")), text, m("eventid"), F.map_filter("_m", lambda k, v: ~k.isin("timestamp", "message"))).drop("_m")


PRIORITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")


def journal(lines: DataFrame) -> DataFrame:
    """Journal JSON export: microsecond epoch, priority names, lists joined by spaces, the message's first address."""
    rows = lines.withColumn("_m", json_map(F.col("raw")))
    m = lambda k: F.col("_m")[k]
    joined = F.transform_values("_m", lambda k, v: F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), " ")).otherwise(v))
    text = F.when(m("MESSAGE").startswith("["), F.array_join(F.from_json(m("MESSAGE"), "array<string>"), " ")).otherwise(m("MESSAGE"))
    ip = F.regexp_extract(text, r"\b((?:\d{1,3}\.){3}\d{1,3})\b", 1)
    priority = F.get(F.array(*map(F.lit, PRIORITIES)), m("PRIORITY").try_cast("int"))
    ts = F.date_trunc("millisecond", F.timestamp_micros(m("__REALTIME_TIMESTAMP").try_cast("long")))
    ok = m("__REALTIME_TIMESTAMP").isNotNull()
    attributes = F.map_concat(F.map_filter(clean_attributes(joined), lambda k, v: ~k.isin("MESSAGE", "__REALTIME_TIMESTAMP", "PRIORITY")), attributes_of(priority=priority, src_ip=ip))
    return event_rows(rows, ok, ts, text, F.concat(F.lit("journal:"), F.coalesce(m("SYSLOG_IDENTIFIER"), F.lit("?"))), attributes).drop("_m")


def web_honeypot(lines: DataFrame) -> DataFrame:
    """HTTP honeypot JSON: headers, effective client, URL parts, a request-forgery target, JSON-RPC fields."""
    rows = lines.withColumn("_m", json_map(F.col("raw")))
    m = lambda k: F.col("_m")[k]
    headers = json_map(F.coalesce(m("headers"), F.lit("{}")))
    rows = rows.withColumn("_h", F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    head = lambda k: F.col("_h")[k]
    client = F.coalesce(head("x-real-ip"), F.trim(F.get(F.split(head("x-forwarded-for"), ","), 0)), m("src_ip"))
    url = F.coalesce(m("url"), m("path"), F.lit(""))
    full = F.when(url.startswith("/"), F.concat(F.lit("http://host"), url)).otherwise(url)
    query = F.try_parse_url(full, F.lit("QUERY"))
    params = F.str_to_map(F.coalesce(query, F.lit("")), F.lit("&"), F.lit("="))
    target = F.get(F.filter(F.map_values(F.transform_values(params, lambda k, v: F.try_url_decode(v))), lambda v: v.rlike(r"^(https?|gopher|file|dict)://")), 0)
    body = m("body")
    attributes = attributes_of(src_ip=client, method=m("method"), uri=url, path=F.try_parse_url(full, F.lit("PATH")), query=query, user_agent=head("user-agent"), host=head("host"), referer=head("referer"), ssrf_target=target, rpc_method=F.get_json_object(body, "$.method"), rpc_id=F.get_json_object(body, "$.id"), body=body)
    ok = m("timestamp").isNotNull() & m("method").isNotNull()
    return event_rows(rows, ok, F.date_trunc("millisecond", m("timestamp").try_cast("timestamp")), F.concat_ws(" ", m("method"), url), "webhoneypot", attributes, "Request Time").drop("_m", "_h")


#: What well-known event ids mean.
WINDOWS_EVENTS = {"4624": "Successful logon", "4625": "Failed logon", "4634": "Logoff", "4648": "Logon with explicit credentials", "4672": "Special privileges assigned", "4688": "Process created", "4720": "User account created", "4726": "User account deleted", "7045": "Service installed", "1102": "Audit log cleared"}


def _windows(rows: DataFrame, event: Column, time: Column, host: Column, channel: Column, data: Column) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in WINDOWS_EVENTS.items() for x in kv])
    what = F.coalesce(names[event], F.concat(F.lit("Event "), event))
    who = F.coalesce(data["TargetUserName"], data["SubjectUserName"])
    text = F.concat_ws(" ", what, F.when(who.isNotNull(), F.concat(F.lit("user="), who)), F.when(data["NewProcessName"].isNotNull(), F.concat(F.lit("process="), data["NewProcessName"])))
    attributes = F.map_concat(F.map_filter(clean_attributes(data), lambda k, v: ~k.isin("event_id", "host", "channel")), attributes_of(event_id=event, host=host, channel=channel))
    return event_rows(rows, event.isNotNull(), F.date_trunc("millisecond", time.try_cast("timestamp")), text, F.concat(F.lit("windows:"), event), attributes, "Event Time")


def windows_json(lines: DataFrame) -> DataFrame:
    """JSON lines with Event.System and Event.EventData."""
    get = lambda p: F.get_json_object("raw", f"$.Event.{p}")
    data = F.coalesce(json_map(get("EventData")), F.create_map().cast("map<string,string>"))
    event = F.coalesce(F.get_json_object("raw", "$.Event.System.EventID.#text"), get("System.EventID"))
    return _windows(lines, event, F.coalesce(get("System.TimeCreated.#attributes.SystemTime"), get("System.TimeCreated")), get("System.Computer"), get("System.Channel"), data)


WINDOWS_XML = "System struct<EventID:string,TimeCreated:struct<_SystemTime:string>,Computer:string,Channel:string>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"


def windows_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML exports, one row an Event element."""
    rows = spark.read.schema(WINDOWS_XML).format("xml").option("rowTag", "Event").load(path)
    pairs = F.filter(F.coalesce("EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d: d["_Name"].isNotNull())
    data = F.map_from_entries(F.transform(pairs, lambda d: F.struct(d["_Name"].alias("key"), d["_VALUE"].alias("value"))))
    out = _windows(rows.withColumn("_d", data), F.col("System.EventID"), F.col("System.TimeCreated._SystemTime"), F.col("System.Computer"), F.col("System.Channel"), F.col("_d"))
    return out.drop("System", "EventData", "_d")
