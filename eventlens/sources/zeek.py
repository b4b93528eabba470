"""Network logs whose headers name the separator, the fields and the kind of log, and may change inside a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import clean_attributes
from ..functions.storage import carried_last
from .logs import event_rows
from .text import attributes_of

#: Bytes of a file whose lines are put in order by one task.
STRETCH = 8 << 20

#: Kind of log, what one of its lines is, and what its time means.
KINDS = {
    "conn": ("connection", "Connection Time"),
    "dns": ("query", "DNS Query Time"),
    "http": ("request", "HTTP Request Time"),
    "ssl": ("connection", "TLS Connection Time"),
    "ssh": ("session", "SSH Session Time"),
    "ftp": ("session", "FTP Session Time"),
    "smtp": ("message", "SMTP Message Time"),
    "files": ("file", "File Analysis Time"),
    "notice": ("alert", "Notice Time"),
    "weird": ("anomaly", "Weird Activity Time"),
    "x509": ("certificate", "Certificate Seen Time"),
    "software": ("software", "Software Seen Time"),
    "kerberos": ("request", "Kerberos Request Time"),
    "ntlm": ("authentication", "NTLM Authentication Time"),
    "rdp": ("connection", "RDP Connection Time"),
    "dhcp": ("lease", "DHCP Lease Time"),
    "sip": ("call", "SIP Call Time"),
    "snmp": ("query", "SNMP Query Time"),
    "irc": ("message", "IRC Message Time"),
    "dce_rpc": ("call", "DCE/RPC Call Time"),
    "smb_files": ("file_access", "SMB File Access Time"),
    "smb_mapping": ("share_access", "SMB Share Access Time"),
    "tunnel": ("tunnel", "Tunnel Time"),
    "dpd": ("protocol_violation", "Protocol Violation Time"),
    "known_hosts": ("host", "Known Host Time"),
    "known_services": ("service", "Known Service Time"),
    "known_certs": ("certificate", "Known Certificate Time"),
    "traceroute": ("traceroute", "Traceroute Time"),
    "pe": ("binary", "PE Binary Time"),
}

#: Fields that become columns or common attributes, and are not kept under their own names.
PROMOTED = ("ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p")


def _header(name: str) -> Column:
    """What a header line of that name says; null for other lines. Its name ends at one separator or space."""
    return F.when(F.col("raw").startswith(f"#{name}") & F.col("raw").rlike(rf"^#{name}\W"), F.expr(f"substring(raw, {len(name) + 3})"))


def _separator() -> Column:
    """The separator that a header names, which may be written as its code."""
    said = _header("separator")
    code = F.regexp_extract(said, r"^\\x([0-9a-fA-F]{2})$", 1)
    return F.when(code != "", F.chr(F.conv(code, 16, 10).cast("int"))).otherwise(said)


#: What is said of a line of each kind: parts joined by spaces, a word in front of a mark or a field that may have words before it; fields without a value are left out.
#: Made from several fields: flow, sizes, url, and the first of some names.
TEXTS = {
    "conn": "proto, flow, conn_state, service, sizes",
    "dns": "dns!, qtype_name, query, -> answers",
    "http": "method, url, status_code",
    "ssl": "tls!, flow, server_name, version, validation_status",
    "ssh": "ssh!, flow, auth_success, client",
    "ftp": "ftp!, command, arg, flow",
    "smtp": "mail!, from mailfrom, to rcptto, subject subject",
    "files": "file!, filename/fuid, mime_type, bytes seen_bytes, sha256",
    "notice": "notice!, note, msg",
    "weird": "weird!, name, addl",
    "x509": "certificate!, certificate.subject/id",
    "software": "software!, name, version.addl/version.major, on host",
    "dhcp": "dhcp!, mac, got assigned_addr",
    "kerberos": "kerberos!, request_type, client, for service, error_msg",
    "ntlm": "ntlm!, domainname, username, from hostname, success success",
    "rdp": "rdp!, flow, cookie, result",
    "smb_files": "smb!, action, path, name",
    "smb_mapping": "smb share!, path, share_type",
    "dce_rpc": "rpc!, endpoint, operation",
    "sip": "sip!, method, uri, status_code",
    "pe": "binary!, id, machine, os",
}
OTHER = "flow"


def _values(m: Callable[[str], Column], flow: Column) -> Column:
    """The line's fields, and those that are made from several."""
    alternatives = sorted({p.split(" ")[-1] for t in TEXTS.values() for p in t.split(", ") if "/" in p})
    first = lambda names: F.coalesce(*[F.nullif(m(n), F.lit("")) for n in names.split("/")], F.lit(""))
    some = F.concat(m("orig_bytes"), m("resp_bytes")) != ""
    sizes = F.when(some, F.concat(_or0(m("orig_bytes")), F.lit("/"), _or0(m("resp_bytes")), F.lit(" bytes"))).otherwise("")
    made = {"flow": flow, "sizes": sizes, "url": F.concat(m("host"), m("uri")), **{n: first(n) for n in alternatives}}
    return F.map_concat("_m", F.create_map(*[x for n, v in made.items() for x in (F.lit(n), v)]))


def _text(kind: Column, values: Column) -> Column:
    """The text of a line, from the parts that its kind names; one small expression, whatever the number of kinds."""
    texts = F.create_map(*[F.lit(x) for pair in TEXTS.items() for x in pair])
    parts = F.split(F.coalesce(texts[kind], F.concat(kind, F.lit(f"!, {OTHER}"))), ", ")

    def said(part: Column) -> Column:
        name = F.substring_index(part, " ", -1)
        value = F.coalesce(values[name], F.lit(""))
        before = F.left(part, F.length(part) - F.length(name))
        return F.when(part.endswith("!"), F.left(part, F.length(part) - 1)).when(value != "", F.concat(before, value)).otherwise("")

    return F.array_join(F.filter(F.transform(parts, said), lambda x: x != ""), " ")


def _or0(c: Column) -> Column:
    return F.when(c == "", "0").otherwise(c)


def zeek(lines: DataFrame) -> DataFrame:
    """Events of lines (source_file, byte_offset, raw), a row for each line that is not a header.

    Each line is read by the separator, fields, kind, markers and opening time that were last named before it. A file
    is cut into stretches of bytes; what headers say at the end of each is carried on to the next. Without a kind the
    file's name stands for it; lines without a time have the opening time, or none. `ok` is false before the first
    fields, for another number of values, and for times that are no numbers. Blank and null lines are left out.
    """
    heads = {
        "_sep": _separator(),
        "_fields": _header("fields"),
        "_path": _header("path"),
        "_empty": _header("empty_field"),
        "_unset": _header("unset_field"),
        "_open": _header("open"),
    }
    rows = lines.where(F.length("raw") > 0).withColumn("_part", F.floor(F.col("byte_offset") / STRETCH))
    rows = carried_last(rows, ["source_file"], "_part", ["byte_offset"], heads).where(~F.col("raw").startswith("#")).drop("_part")
    tabs, other = F.coalesce(F.col("_sep") == "\t", F.lit(True)), F.concat(F.lit("\\Q"), F.col("_sep"), F.lit("\\E"))
    cut = lambda c: F.when(tabs, F.split(c, "\t")).otherwise(F.split(c, other))  # noqa: E731  (a fixed separator is no pattern to compile)
    rows = rows.withColumns({"_names": cut("_fields"), "_parts": cut("raw")})
    names, parts = F.col("_names"), F.col("_parts")
    fits = F.col("_fields").isNotNull() & (F.size(names) == F.size(parts))
    unset = lambda v: v.isin("-", "(empty)") | F.coalesce(v == F.col("_empty"), F.lit(False)) | F.coalesce(v == F.col("_unset"), F.lit(False))
    clean = F.transform(parts, lambda v: F.when(unset(v), "").otherwise(v))
    rows = rows.withColumn("_m", F.when(fits, F.map_from_arrays(names, clean)))
    m = lambda k: F.coalesce(F.col("_m")[k], F.lit(""))

    seconds = m("ts").try_cast("decimal(20,6)")
    ok = fits & ((m("ts") == "") | seconds.isNotNull())
    opened = F.try_to_timestamp(F.col("_open"), F.lit("yyyy-MM-dd-HH-mm-ss"))
    ts = F.when(m("ts") == "", opened).otherwise(F.timestamp_millis(F.floor(seconds * 1000).cast("long")))

    kind = F.coalesce("_path", F.element_at(F.split("source_file", "/"), -1), F.lit("?"))
    about = F.create_map(*[x for k, (event, desc) in KINDS.items() for x in (F.lit(k), F.array(F.lit(event), F.lit(desc)))])[kind]
    desc = F.coalesce(F.get(about, 1), F.concat(F.lit("Zeek "), kind, F.lit(" Time")))

    flow = F.concat(m("id.orig_h"), F.lit(":"), m("id.orig_p"), F.lit(" -> "), m("id.resp_h"), F.lit(":"), m("id.resp_p"))
    flow = F.when(m("id.orig_h") != "", flow).otherwise("")
    rows = rows.withColumn("_v", _values(m, flow))  # a column of its own: made once a row, not once a part
    text = _text(kind, F.col("_v"))

    is_http = kind == "http"
    own = F.map_filter(clean_attributes(F.coalesce("_m", F.create_map().cast("map<string,string>"))), lambda k, v: ~k.isin(*PROMOTED, "src_ip", "dst_ip", "src_port", "dst_port", "url", "event", "zeek_log") & ~(is_http & (k == "uri")))
    common = attributes_of(
        src_ip=m("id.orig_h"),
        src_port=m("id.orig_p"),
        dst_ip=m("id.resp_h"),
        dst_port=m("id.resp_p"),
        url=F.when(is_http, F.concat(m("host"), m("uri"))).otherwise(m("url")),
        event=F.coalesce(F.get(about, 0), F.lit("log")),
        zeek_log=kind,
    )
    out = event_rows(rows, ok, ts, text, F.concat(F.lit("zeek:"), kind), F.map_concat(own, common), desc)
    return out.drop(*heads, "_names", "_parts", "_m", "_v")
