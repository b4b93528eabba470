"""Sources and sinks: log lines are rendered from the test events and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import normalize as N
from ..functions.storage import new_folder
from ..sources import exchange as EX
from ..sources import logs as L
from ..sources import text as T
from ..sources import timelines as TL
from . import query
from .filters import AN, annotations

def USER():
    return F.col("attributes")["user"]


def CENTS():
    return F.col("attributes")["cents"]


def K():
    return F.col("attributes")["k"]


def IP():
    return F.coalesce(F.col("attributes")["src_ip"], F.col("attributes")["ip_addr"])


def ID():
    return F.col("event_id").cast("long")


def _lines(spark, sf, raw):
    return X.events(spark, sf).where("timestamp IS NOT NULL").select("event_id", raw.alias("raw"))


def _nginx(spark, sf):
    time = F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss +0000")
    access = F.concat(IP(), F.lit(" - user-"), USER(), F.lit(" ["), time, F.lit('] "GET /'), F.col("artifact"), F.lit("?k="), K(), F.lit(' HTTP/1.1" '), F.when(F.col("artifact") == "error", "500").otherwise("200"), F.lit(" "), CENTS(), F.lit(' "-" "'), F.col("attributes")["ua"], F.lit('"'))
    error = F.concat(F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss"), F.lit(" [error] 12#"), USER(), F.lit(": *"), K(), F.lit(" upstream failed, client: "), IP())
    return _lines(spark, sf, F.when(ID() % 11 == 0, "not a log line").when(ID() % 7 == 0, error).otherwise(access))


IPX = "coalesce(a_src_ip, a_ip_addr)"
SEC = "ms // 1000 * 1000"


def _flat(*keys):
    return [F.coalesce(F.col("attributes")[k], F.lit("")).alias(k) for k in keys]


@query(
    "src_nginx",
    X.sql(
        f"""SELECT event_id, {SEC} AS ms, CASE WHEN e THEN 'nginx:error' ELSE 'nginx:access' END AS artifact, {IPX} AS src_ip, CASE WHEN e THEN '' ELSE 'user-' || a_user END AS "user", CASE WHEN e THEN '' ELSE '/' || artifact || '?k=' || a_k END AS uri, CASE WHEN e THEN '' WHEN artifact = 'error' THEN '500' ELSE '200' END AS status, CASE WHEN e THEN '' ELSE a_cents END AS size, CASE WHEN e THEN '' ELSE a_ua END AS user_agent, CASE WHEN e THEN a_k ELSE '' END AS connection, CASE WHEN e THEN 'upstream failed, client: ' || {IPX} ELSE 'GET /' || artifact || '?k=' || a_k || ' HTTP/1.1 ' || CASE WHEN artifact = 'error' THEN '500' ELSE '200' END END AS message FROM (SELECT *, CAST(event_id AS BIGINT) % 7 = 0 AS e FROM ev WHERE ms IS NOT NULL AND CAST(event_id AS BIGINT) % 11 <> 0)"""
    ),
)
def src_nginx(spark, sf):
    out = L.nginx(_nginx(spark, sf)).where("ok")
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "artifact", *_flat("src_ip", "user", "uri", "status", "size", "user_agent", "connection"), "message")


@query(
    "src_apache",
    X.sql(
        f"""SELECT event_id, {SEC} AS ms, CASE WHEN n % 4 < 2 THEN 'apache:access' ELSE 'apache:error' END AS artifact, {IPX} AS src_ip, CASE n % 4 WHEN 1 THEN 'www.host.example' ELSE '' END AS vhost, CASE n % 4 WHEN 2 THEN 'core' ELSE '' END AS module, CASE WHEN n % 4 < 2 THEN '' ELSE 'error' END AS level, CASE n % 4 WHEN 2 THEN 'AH0' || a_k ELSE '' END AS code, CASE n % 4 WHEN 2 THEN '40' || a_k ELSE '' END AS src_port FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL)"""
    ),
)
def src_apache(spark, sf):
    time = F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss +0000")
    access = F.concat(IP(), F.lit(" - - ["), time, F.lit('] "GET / HTTP/1.0" 200 '), CENTS())
    stamp = F.date_format("timestamp", "EEE MMM dd HH:mm:ss")
    e24 = F.concat(F.lit("["), stamp, F.lit(".000000 2024] [core:error] [pid 7:tid 8] [client "), IP(), F.lit(":40"), K(), F.lit("] AH0"), K(), F.lit(": it failed"))
    e22 = F.concat(F.lit("["), stamp, F.lit(" 2024] [error] [client "), IP(), F.lit("] it failed"))
    raw = F.when(ID() % 4 == 0, access).when(ID() % 4 == 1, F.concat(F.lit("www.host.example:443 "), access)).when(ID() % 4 == 2, e24).otherwise(e22)
    out = L.apache(_lines(spark, sf, raw)).where("ok")
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "artifact", *_flat("src_ip", "vhost", "module", "level", "code", "src_port"))


@query(
    "src_filterlog",
    X.sql(
        f"""SELECT event_id, {SEC} AS ms, 'firewall:filterlog:' || CASE WHEN artifact = 'error' THEN 'block' ELSE 'pass' END AS artifact, CASE WHEN n % 5 = 0 THEN 'fe80::' || a_k ELSE {IPX} END AS src_ip, CASE WHEN n % 5 = 0 THEN 'fe80::1' ELSE '10.9.9.9' END AS dst_ip, CASE WHEN n % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol, CASE WHEN n % 3 = 0 THEN '' ELSE '5' || a_k END AS src_port, CASE WHEN n % 3 = 0 THEN '' ELSE '443' END AS dst_port FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL) WHERE n % 13 <> 0"""
    ),
)
def src_filterlog(spark, sf):
    proto = F.when(ID() % 2 == 0, "tcp").otherwise("udp")
    tail = F.when(ID() % 3 == 0, "").otherwise(F.concat(F.lit(",5"), K(), F.lit(",443,0"), F.when(ID() % 2 == 0, ",S,1,,64,,").otherwise("")))
    head = F.concat(F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" fw filterlog[12]: 4,,,100,igb0,match,"), F.when(F.col("artifact") == "error", "block").otherwise("pass"), F.lit(",in,"))
    v4 = F.concat(head, F.lit("4,0x0,,64,1,0,DF,6,"), proto, F.lit(",52,"), IP(), F.lit(",10.9.9.9"), tail)
    v6 = F.concat(head, F.lit("6,0x00,0x1,64,"), proto, F.lit(",6,52,fe80::"), K(), F.lit(",fe80::1"), tail)
    raw = F.when(ID() % 13 == 0, F.concat(head, F.lit("4,short"))).when(ID() % 5 == 0, v6).otherwise(v4)
    out = L.filterlog(_lines(spark, sf, raw), 2024).where("ok")
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "artifact", *_flat("src_ip", "dst_ip", "protocol", "src_port", "dst_port"))


@query(
    "src_syslog",
    X.sql(
        f"""SELECT event_id, {SEC} AS ms, 'syslog:' || CASE n % 4 WHEN 3 THEN 'app' WHEN 2 THEN 'sudo' ELSE 'sshd' END AS artifact, CASE n % 4 WHEN 0 THEN 'ssh_login' WHEN 1 THEN 'ssh_failed' WHEN 2 THEN 'sudo_command' ELSE '' END AS event, CASE WHEN n % 4 = 3 THEN '' ELSE 'user-' || a_user END AS "user", CASE WHEN n % 4 < 2 THEN {IPX} ELSE '' END AS src_ip, CASE n % 4 WHEN 2 THEN '/bin/' || artifact ELSE '' END AS command FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL)"""
    ),
)
def src_syslog(spark, sf):
    user = F.concat(F.lit("user-"), USER())
    login = F.concat(F.lit("sshd[9]: "), F.when(ID() % 4 == 0, "Accepted password for ").otherwise("Failed password for invalid user "), user, F.lit(" from "), IP(), F.lit(" port 2222 ssh2"))
    sudo = F.concat(F.lit("sudo: "), user, F.lit(" : TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND=/bin/"), F.col("artifact"))
    text = F.when(ID() % 4 < 2, login).when(ID() % 4 == 2, sudo).otherwise(F.concat(F.lit("app[1]: took "), K()))
    head = F.when(ID() % 2 == 0, F.date_format("timestamp", "MMM d HH:mm:ss")).otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    out = L.syslog(_lines(spark, sf, F.concat(head, F.lit(" host1 "), text)), 2024).where("ok")
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "artifact", *_flat("event", "user", "src_ip", "command"))


@query(
    "src_suricata",
    X.sql(
        f"""SELECT event_id, ms, CASE n % 3 WHEN 1 THEN 'suricata:http' ELSE 'suricata:alert' END AS artifact, {IPX} AS src_ip, '10.9.9.9' AS dst_ip, CASE n % 3 WHEN 1 THEN 'GET host.example/' || a_k ELSE 'alert: rule ' || a_k END AS message FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL)"""
    ),
)
def src_suricata(spark, sf):
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    head = F.concat(F.lit('{"timestamp":"'), ts, F.lit('+0000","src_ip":"'), IP(), F.lit('","dest_ip":"10.9.9.9","proto":"TCP",'))
    alert = F.concat(head, F.lit('"event_type":"alert","alert":{"signature":"rule '), K(), F.lit('","severity":2}}'))
    http = F.concat(head, F.lit('"event_type":"http","http":{"http_method":"GET","hostname":"host.example","url":"/'), K(), F.lit('"}}'))
    fast = F.concat(F.date_format("timestamp", "MM/dd/yyyy-HH:mm:ss.SSSSSS"), F.lit("  [**] [1:2:3] rule "), K(), F.lit(" [**] [Classification: x] [Priority: 2] {TCP} "), IP(), F.lit(":40 -> 10.9.9.9:80"))
    raw = F.when(ID() % 3 == 0, F.concat(F.lit("a\thost\t"), alert)).when(ID() % 3 == 1, http).otherwise(fast)
    out = L.suricata(_lines(spark, sf, raw)).where("ok")
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "artifact", *_flat("src_ip", "dst_ip"), "message")


@query("src_timefilter", X.sql("SELECT CAST(count_if(n % 11 <> 0 AND s >= epoch_ms(TIMESTAMP '2024-01-10') AND s < epoch_ms(TIMESTAMP '2024-01-20')) AS BIGINT) AS parsed, CAST(count_if(n % 11 = 0) AS BIGINT) AS malformed, CAST(count_if(n % 11 <> 0 AND NOT (s >= epoch_ms(TIMESTAMP '2024-01-10') AND s < epoch_ms(TIMESTAMP '2024-01-20'))) AS BIGINT) AS out_of_range FROM (SELECT CAST(event_id AS BIGINT) AS n, ms // 1000 * 1000 AS s FROM ev WHERE ms IS NOT NULL)"))
def src_timefilter(spark, sf):
    return T.time_bounds(L.nginx(_nginx(spark, sf)), "2024-01-10", "2024-01-20")[1]


@query("src_jsonl", X.sql("""SELECT event_id, coalesce(ms, -1) AS ms, message, artifact, a_k AS k, '{"a":' || a_k || '}' AS nested, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ';') ELSE '' END AS tags FROM ev WHERE CAST(event_id AS BIGINT) % 9 <> 0"""))
def src_jsonl(spark, sf):
    body = F.to_json(F.struct(F.col("message").alias("msg"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("datetime"), F.col("artifact").alias("data_type"), "tags", F.struct(K().cast("int").alias("a")).alias("nested"), K().alias("k"), F.lit("").alias("blank")))
    lines = X.events(spark, sf).select("event_id", F.when(ID() % 9 == 0, "[1, 2").otherwise(body).alias("raw"))
    out = TL.from_json_lines(lines)
    return out.select("event_id", F.coalesce(F.unix_millis("timestamp"), F.lit(-1)).alias("ms"), "message", "artifact", *_flat("k", "nested"), F.array_join("tags", ";").alias("tags"))


@query("ts_parse", X.sql("SELECT event_id, CASE n % 6 WHEN 0 THEN ms // 1000 * 1000 WHEN 1 THEN ms WHEN 2 THEN ms WHEN 3 THEN ms // 1000 * 1000 WHEN 4 THEN ms - 7200000 ELSE -1 END AS ms FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL)"))
def ts_parse(spark, sf):
    ms = F.unix_millis("timestamp")
    text = F.when(ID() % 6 == 0, F.floor(ms / 1000).cast("string")).when(ID() % 6 == 1, ms.cast("string")).when(ID() % 6 == 2, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS")).when(ID() % 6 == 3, F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss +0000")).when(ID() % 6 == 4, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0200'")).otherwise("yesterday")
    return X.events(spark, sf).where("timestamp IS NOT NULL").select("event_id", F.coalesce(F.unix_millis(N.parse_time(text)), F.lit(-1)).alias("ms"))


@query("tags_split", X.sql("SELECT event_id, CASE n % 5 WHEN 0 THEN 'a;' || a_k WHEN 1 THEN artifact || ';' || a_k WHEN 2 THEN artifact || ';x' WHEN 3 THEN artifact ELSE '' END AS tags FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev)"))
def tags_split(spark, sf):
    text = F.when(ID() % 5 == 0, F.concat(F.lit("['a', '"), K(), F.lit("']"))).when(ID() % 5 == 1, F.concat("artifact", F.lit(" ,, "), K())).when(ID() % 5 == 2, F.concat("artifact", F.lit("| x |"))).when(ID() % 5 == 3, F.concat(F.lit(" "), "artifact")).otherwise(" ")
    return X.events(spark, sf).select("event_id", F.array_join(N.split_tags(text), ";").alias("tags"))


@query("event_id", X.sql("SELECT event_id AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT event_id, sha1(unhex('" + N.NAMESPACE.hex + "') || encode('case-1' || chr(10) || source_id || chr(10) || 'f' || chr(10) || byte_offset || chr(10) || sha256(message) || chr(10) || 'p' || chr(10) || '1')) AS h FROM ev)"))
def event_id(spark, sf):
    ev = X.events(spark, sf).withColumns({"id": F.col("event_id"), "file_hash": F.lit("f"), "content_hash": N.content_hash(F.col("message")), "parser_name": F.lit("p"), "parser_version": F.lit("1")})
    return ev.select("id", N.event_id().alias("uuid"))


@query("content_hash", X.sql("SELECT event_id, sha256(message) AS content_hash FROM ev"))
def content_hash(spark, sf):
    return X.events(spark, sf).select("event_id", N.content_hash(F.col("message")).alias("content_hash"))


@query("ip_normalize")
def ip_normalize(spark, sf):
    """No SQL: tests compare with the standard library's addresses."""
    return X.events(spark, sf).select("event_id", N.normalize_ip(F.when(ID() % 3 == 0, F.concat(F.lit("FE80:0:0::"), K())).otherwise(IP())).alias("ip"))


@query("ingest_dedup", X.sql("SELECT DISTINCT sha256(artifact || a_k) AS file_hash FROM ev WHERE sha256(artifact || a_k) NOT IN (SELECT sha256(artifact || a_k) FROM ev WHERE a_action = 'exfil')"))
def ingest_dedup(spark, sf):
    ev = X.events(spark, sf)
    files = ev.select(F.sha2(F.concat("artifact", K()), 256).alias("file_hash"), F.col("event_id").alias("source_file"))
    known = ev.where(F.col("attributes")["action"] == "exfil").select(F.sha2(F.concat("artifact", K()), 256).alias("file_hash"))
    return T.new_files(files, known).select("file_hash")


NOTE = ", nt AS (SELECT event_id, list({'kind': kind, 'value': value} ORDER BY kind, value) AS notes FROM an GROUP BY event_id)"


@query(
    "snk_jsonl",
    X.sql(
        f"""{AN}{NOTE} SELECT event_id, '{{"annotations":[' || coalesce(array_to_string(list_transform(notes, lambda x: '{{"kind":"' || x.kind || '","value":"' || x.value || '"}}'), ','), '') || '],"artifact":"' || artifact || '","event_id":"' || event_id || '","message":"' || message || '","timestamp":' || coalesce('"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 'Z"', 'null') || '}}' AS line FROM ev LEFT JOIN nt USING (event_id)"""
    ),
)
def snk_jsonl(spark, sf):
    return EX.json_rows(X.events(spark, sf).select("event_id", "artifact", "message", "timestamp"), annotations(spark, sf))


@query(
    "snk_csv",
    X.sql(
        f"""{AN}{NOTE} SELECT event_id, source_id, coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 'Z', '') AS "timestamp", artifact, message, array_to_string(tags, ';') AS tags, (SELECT '{{' || string_agg('"' || key || '":"' || val || '"', ',' ORDER BY key) || '}}' FROM av WHERE av.event_id = ev.event_id) AS attributes,
        coalesce(array_to_string(list_transform(list_filter(notes, lambda x: x.kind = 'tag'), lambda x: x.value), ';'), '') AS user_tags, coalesce(array_to_string(list_transform(list_filter(notes, lambda x: x.kind = 'comment'), lambda x: x.value), ';'), '') AS comments, coalesce(array_to_string(list_transform(list_filter(notes, lambda x: x.kind = 'anomaly'), lambda x: x.value), ';'), '') AS anomaly_findings FROM ev LEFT JOIN nt USING (event_id)"""
    ),
)
def snk_csv(spark, sf):
    return EX.csv_rows(X.events(spark, sf), annotations(spark, sf))


@query("imp_case", X.sql("SELECT event_id, 'case-2' AS case_id, 'new-' || source_id AS source_id, '' AS embedding_model, message FROM ev"))
def imp_case(spark, sf):
    rows = X.events(spark, sf).withColumn("embedding_model", F.lit("m"))
    out = EX.import_case(rows, "case-2", {f"src-{i}": f"new-src-{i}" for i in range(4)})
    return out.select("event_id", "case_id", "source_id", "embedding_model", "message")


@query("exp_case", X.sql("SELECT source_id, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars, CAST(sum(coalesce(ms, 0)) AS BIGINT) AS ms FROM ev GROUP BY source_id"))
def exp_case(spark, sf):
    """Written by source into the shared folder and read again."""
    folder = new_folder(spark, "case")
    EX.export_case(X.events(spark, sf), "case-1", folder)
    return EX.read_events(spark, folder).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars"), F.sum(F.coalesce(F.unix_millis("timestamp"), F.lit(0))).alias("ms"))


@query("del_source", X.sql("SELECT source_id, count(*) AS n FROM ev WHERE source_id <> 'src-2' GROUP BY source_id"))
def del_source(spark, sf):
    return EX.without_source(X.events(spark, sf), "src-2").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
