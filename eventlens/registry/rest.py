"""Further log families, file round trips and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.fields import effective_time
from ..functions.storage import new_folder as folder
from ..sources import exchange as EX
from ..sources import logs as L
from ..sources import text as T
from ..sources import timelines as TL
from ..sources import zeek as Z
from ..streaming import streams as ST
from . import query
from .sources import ID, IP, K, SEC, USER, _flat, _lines

IPX = "coalesce(a_src_ip, a_ip_addr)"


def _ms():
    return F.coalesce(F.unix_millis("timestamp"), F.lit(-1)).alias("ms")


@query(
    "src_zeek",
    X.sql(f"SELECT event_id, {SEC} AS ms, CASE WHEN n < 3000 THEN 'zeek:conn' ELSE 'zeek:dns' END AS artifact, {IPX} AS src_ip, CASE WHEN n < 3000 THEN '' ELSE 'q' || a_k || '.example' END AS query, CASE WHEN n < 3000 THEN 'tcp ' || {IPX} || ':40 -> 10.9.9.9:80 SF' ELSE 'dns A q' || a_k || '.example' END AS message FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL)"),
)
def src_zeek(spark, sf):
    """Two headers in one file: connections up to a row, name queries after it."""
    sec = F.floor(F.unix_millis("timestamp") / 1000).cast("string")
    conn = F.concat_ws("\t", sec, IP(), F.lit("40"), F.lit("10.9.9.9"), F.lit("80"), F.lit("tcp"), F.lit("SF"), F.lit("-"))
    dns = F.concat_ws("\t", sec, IP(), F.lit("40"), F.lit("10.9.9.9"), F.lit("53"), F.lit("A"), F.concat(F.lit("q"), K(), F.lit(".example")))
    rows = _lines(spark, sf, F.when(ID() < 3000, conn).otherwise(dns)).select("event_id", "raw", (F.col("event_id").cast("long") * 100 + 50).alias("byte_offset"))
    flow = "ts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p"
    heads = [(-3, "#separator \\x09"), (-2, f"#path\tconn"), (-1, f"#fields\t{flow}\tproto\tconn_state\tservice"), (300_001, "#path\tdns"), (300_002, f"#fields\t{flow}\tqtype_name\tquery")]
    lines = rows.withColumn("byte_offset", F.when(F.col("byte_offset") > 300_000, F.col("byte_offset") + 10).otherwise(F.col("byte_offset")))
    head = spark.createDataFrame([("", h, at) for at, h in heads], "event_id string, raw string, byte_offset long")
    out = Z.zeek(lines.unionByName(head).withColumn("source_file", F.lit("zeek.log"))).where("ok")
    return out.select("event_id", _ms(), "artifact", *_flat("src_ip", "query"), "message")


@query("src_cowrie", X.sql(f"""SELECT event_id, ms, CASE WHEN n % 2 = 0 THEN 'cowrie.command.input' ELSE 'cowrie.login.failed' END AS artifact, CASE WHEN n % 2 = 0 THEN 'command: run ' || a_k ELSE 'login user-' || a_user || ' pw' END AS message, {IPX} AS src_ip, '22' AS "geo.port" FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL AND CAST(event_id AS BIGINT) % 10 <> 0)"""))
def src_cowrie(spark, sf):
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(F.when(ID() % 10 != 0, F.when(ID() % 2 == 0, "cowrie.command.input").otherwise("cowrie.login.failed")).alias("eventid"), ts.alias("timestamp"), F.when(ID() % 2 == 0, F.concat(F.lit("run "), K())).alias("input"), F.concat(F.lit("user-"), USER()).alias("username"), F.lit("pw").alias("password"), IP().alias("src_ip"), F.struct(F.lit(22).alias("port")).alias("geo")))
    out = L.cowrie(_lines(spark, sf, body)).where("ok")
    return out.select("event_id", _ms(), "artifact", "message", *_flat("src_ip", "geo.port"))


@query("src_journal", X.sql(f"SELECT event_id, ms, 'journal:app' AS artifact, 'from ' || {IPX} || ' k ' || a_k AS message, {IPX} AS src_ip, CASE WHEN n % 8 = 3 THEN 'error' WHEN n % 8 = 6 THEN 'info' ELSE ['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'info', 'debug'][n % 8 + 1] END AS priority, 'a b' AS many FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL)"))
def src_journal(spark, sf):
    body = F.to_json(F.struct((F.unix_millis("timestamp") * 1000).cast("string").alias("__REALTIME_TIMESTAMP"), F.concat(F.lit("from "), IP(), F.lit(" k "), K()).alias("MESSAGE"), (ID() % 8).cast("string").alias("PRIORITY"), F.lit("app").alias("SYSLOG_IDENTIFIER"), F.array(F.lit("a"), F.lit("b")).alias("many")))
    out = L.journal(_lines(spark, sf, body)).where("ok")
    return out.select("event_id", _ms(), "artifact", "message", *_flat("src_ip", "priority", "many"))


@query("src_webhoneypot", X.sql(f"""SELECT event_id, ms, 'POST /run?u=http%3A%2F%2Fin.example%2F' || a_k AS message, CASE n % 2 WHEN 0 THEN {IPX} ELSE '192.0.2.7' END AS src_ip, '/run' AS path, 'http://in.example/' || a_k AS ssrf_target, 'call' || a_k AS rpc_method, a_ua AS user_agent FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL)"""))
def src_webhoneypot(spark, sf):
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    headers = F.struct(F.when(ID() % 2 == 0, F.concat(IP(), F.lit(", 10.1.1.1"))).alias("X-Forwarded-For"), F.col("attributes")["ua"].alias("User-Agent"))
    body = F.to_json(F.struct(ts.alias("timestamp"), F.lit("POST").alias("method"), F.concat(F.lit("/run?u=http%3A%2F%2Fin.example%2F"), K()).alias("url"), F.lit("192.0.2.7").alias("src_ip"), headers.alias("headers"), F.concat(F.lit('{"jsonrpc":"2.0","method":"call'), K(), F.lit('","id":1}')).alias("body")))
    out = L.web_honeypot(_lines(spark, sf, body)).where("ok")
    return out.select("event_id", _ms(), "message", *_flat("src_ip", "path", "ssrf_target", "rpc_method", "user_agent"))


@query("src_winevt", X.sql("""SELECT event_id, ms, 'windows:' || CASE WHEN n % 2 = 0 THEN '4624' ELSE '9' || a_k END AS artifact, CASE WHEN n % 2 = 0 THEN 'Successful logon' ELSE 'Event 9' || a_k END || ' user=user-' || a_user AS message, 'pc-1' AS host FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ms IS NOT NULL)"""))
def src_winevt(spark, sf):
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    system = F.struct(F.when(ID() % 2 == 0, "4624").otherwise(F.concat(F.lit("9"), K())).alias("EventID"), ts.alias("TimeCreated"), F.lit("pc-1").alias("Computer"))
    data = F.struct(F.concat(F.lit("user-"), USER()).alias("TargetUserName"), F.lit("").alias("Blank"))
    out = L.windows_json(_lines(spark, sf, F.to_json(F.struct(F.struct(system.alias("System"), data.alias("EventData")).alias("Event"))))).where("ok")
    return out.select("event_id", _ms(), "artifact", "message", *_flat("host"))


@query("src_cloudtrail", X.sql(f"""SELECT event_id, {SEC} AS ms, 'user-' || a_user || ' Get' || artifact || ' on s3.amazonaws.com' AS message, CASE WHEN CAST(event_id AS BIGINT) % 4 = 0 THEN '' ELSE {IPX} END AS src_ip, a_k AS "requestParameters.key" FROM ev WHERE ms IS NOT NULL"""))
def src_cloudtrail(spark, sf):
    """Files of records, written from the events and read back."""
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.struct(F.concat(F.lit("Get"), "artifact").alias("eventName"), F.lit("s3.amazonaws.com").alias("eventSource"), ts.alias("eventTime"), F.when(ID() % 4 == 0, "backup.internal").otherwise(IP()).alias("sourceIPAddress"), F.struct(F.concat(F.lit("user-"), USER()).alias("userName"), F.lit("IAMUser").alias("type")).alias("userIdentity"), F.struct(K().alias("key")).alias("requestParameters"), F.col("event_id").alias("eventID"))
    path = folder(spark, "trail")
    rows = X.events(spark, sf).where("timestamp IS NOT NULL").select(record.alias("r"), F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("file"))
    rows.groupBy("file").agg(F.collect_list("r").alias("Records")).select(F.to_json(F.struct("Records")).alias("value")).repartition(8, "value").write.option("lineSep", "\n").text(path)
    out = L.cloudtrail_lines(spark.read.text(path)).where("ok")
    return out.select(F.col("attributes")["eventID"].alias("event_id"), _ms(), "message", *_flat("src_ip", "requestParameters.key"))


@query("src_csv", X.sql("SELECT event_id, coalesce(ms, -1) AS ms, message || chr(10) || 'said \"' || artifact || '\"' AS message, a_ua AS ua, array_to_string(tags, ';') AS tags FROM ev"))
def src_csv(spark, sf):
    """A semicolon-separated timeline with quoted line breaks, written from the events and read back."""
    ev = X.events(spark, sf)
    path = folder(spark, "csv")
    text = F.concat("message", F.lit('\nsaid "'), "artifact", F.lit('"'))
    rows = ev.select(F.col("event_id").alias("id"), text.alias("Message"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("DateTime"), F.array_join("tags", ",").alias("tag"), F.col("attributes")["ua"].alias(" ua "))
    rows.write.options(header=True, sep=";", quote='"', escape='"', quoteAll=True).csv(path)
    out = TL.read_csv(spark, path)
    return out.select(F.col("attributes")["id"].alias("event_id"), _ms(), "message", *_flat("ua"), F.array_join("tags", ";").alias("tags"))


@query("src_parquet", X.sql("SELECT message, coalesce(ms, -1) AS ms, byte_offset, sha256(message) AS content_hash, array_to_string(tags, ';') AS tags FROM ev"))
def src_parquet(spark, sf):
    ev, path = X.events(spark, sf), folder(spark, "interchange")
    ev.withColumns({"file_hash": F.lit("f"), "content_hash": F.sha2("message", 256)}).select(*TL.INTERCHANGE).write.parquet(path)
    out = T.stamp(TL.read_parquet(spark, path), "case-1", "s", "interchange")
    return out.select("message", _ms(), "byte_offset", "content_hash", F.array_join("tags", ";").alias("tags"))


@query("src_generic", X.sql("SELECT count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM ev WHERE ms IS NOT NULL AND artifact <> 'click'"))
def src_generic(spark, sf):
    """Rows without a mandatory value are refused."""
    rows = X.events(spark, sf).withColumn("message", F.when(F.col("artifact") != "click", F.col("message")))
    return TL.require(rows).agg(F.count(F.lit(1)).alias("n"), F.sum(F.unix_millis("timestamp")).alias("ms"))


@query("snk_parquet", X.sql("SELECT case_id, source_id, count(*) AS n FROM ev GROUP BY ALL"))
def snk_parquet(spark, sf):
    path = folder(spark, "events")
    EX.write_parquet(X.events(spark, sf), path, 1000)
    return EX.read_events(spark, path).groupBy("case_id", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query("byte_offset", ", ".join(["WITH l AS (SELECT c_custkey, c_name || ' é ' || c_custkey AS raw FROM customer)", "o AS (SELECT c_custkey, raw, CAST(sum(strlen(raw) + 1) OVER (ORDER BY c_custkey) AS BIGINT) - strlen(raw) - 1 AS byte_offset, row_number() OVER (ORDER BY c_custkey) AS line_number FROM l)"]) + " SELECT byte_offset, line_number, raw FROM o")
def byte_offset(spark, sf):
    """Offsets and numbers of the lines of a text made from the customers, written as part files that follow one another."""
    path = folder(spark, "lines")
    X.read(spark, sf, "customer").orderBy("c_custkey").select(F.concat("c_name", F.lit(" é "), F.col("c_custkey").cast("string")).alias("value")).write.text(path)
    return T.as_one_file(T.read_with_offsets(spark, path))


@query("file_hash", "SELECT sha256(string_agg(c_name, ',' ORDER BY c_custkey) || chr(10)) AS file_hash FROM customer GROUP BY c_nationkey")
def file_hash(spark, sf):
    """Hashes of whole files, one of each nation's customers; files whose hash is known are no new ones."""
    path = folder(spark, "files")
    names = X.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("c"))
    names.select("c_nationkey", F.array_join(F.transform("c", lambda x: x["c_name"]), ",").alias("value")).write.partitionBy("c_nationkey").text(path)
    hashes = T.file_hashes(spark, path)
    return T.new_files(hashes.unionByName(hashes), hashes.where("false")).select("file_hash")


@query(
    "src_csv_records",
    X.sql("""SELECT event_id, sha256('"' || event_id || '";"' || replace(message || chr(10) || 'said "' || artifact || '"', '"', '""') || '";"' || a_ua || '"') AS content_hash, true AS own_id FROM ev"""),
)
def src_csv_records(spark, sf):
    """A timeline's records keep their raw text's hash, and an id each: own_id says that no other record has it."""
    ev, path = X.events(spark, sf), folder(spark, "csv")
    text = F.concat("message", F.lit('\nsaid "'), "artifact", F.lit('"'))
    rows = ev.select(F.col("event_id").alias("id"), text.alias("Message"), F.col("attributes")["ua"].alias("ua"))
    rows.write.options(header=True, sep=";", quote='"', escape='"', quoteAll=True).csv(path)
    out = T.stamp(TL.read_csv(spark, path).withColumn("file_hash", F.sha2("source_file", 256)), "case-1", "s", "csv")
    twice = out.groupBy("event_id").count().where("count > 1").select("event_id", F.lit(False).alias("own"))
    return out.join(twice, "event_id", "left").select(F.col("attributes")["id"].alias("event_id"), "content_hash", F.coalesce("own", F.lit(True)).alias("own_id"))


DIRTY = X.sql("SELECT event_id, 'second ' || a_k AS message, a_k AS k, 'upper' AS \"A\", CASE WHEN CAST(event_id AS BIGINT) % 3 = 0 THEN 'flat' ELSE 'deep' END AS \"a.b\" FROM ev WHERE ms IS NOT NULL AND CAST(event_id AS BIGINT) % 9 <> 0")


@query("src_jsonl_dirty", DIRTY)
def src_jsonl_dirty(spark, sf):
    """Lines with repeated and case-clashing keys, flattened keys that clash, and lines cut off: none stops the job."""
    clash = F.when(ID() % 3 == 0, '{"b":"deep"},"a.b":"flat"').otherwise('{"b":"deep"}')
    body = F.concat(F.lit('{"Message":"first","message":"second '), K(), F.lit('","id":"'), "event_id", F.lit('","k":"0","k":"'), K(), F.lit('","A":"upper","a":'), clash, F.lit("}"))
    lines = _lines(spark, sf, F.when(ID() % 9 == 0, F.substring(body, 1, 40)).otherwise(body))
    deep = lines.select("event_id", L.flat_json(F.col("raw")).alias("m"))
    out = TL.from_json_lines(lines).join(deep, "event_id")
    return out.select("event_id", "message", *_flat("k", "A"), F.col("m")["a.b"].alias("a.b"))


def _stream_files(spark, sf) -> tuple[str, object]:
    path = folder(spark, "stream")
    rows = X.events(spark, sf).where("timestamp IS NOT NULL").select("event_id", "timestamp", "artifact", "display_name")
    rows.unionByName(rows.where("artifact = 'error'")).write.parquet(path)
    return path, rows.schema


@query("st_ingest", X.sql("SELECT artifact, count(*) AS n FROM ev WHERE ms IS NOT NULL GROUP BY artifact"))
def st_ingest(spark, sf):
    """A file stream with repeated events: each id once."""
    path, schema = _stream_files(spark, sf)
    out = ST.run_to_end(ST.ingest(spark, path, schema, late="40 days"), folder(spark, "ingest"), folder(spark, "state"))
    return out.groupBy("artifact").agg(F.count(F.lit(1)).alias("n"))


@query("st_counts", X.sql("SELECT artifact, CAST(ms // 3600000 * 3600 AS BIGINT) AS start, count(*) AS n FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE artifact = 'error') WHERE ms IS NOT NULL GROUP BY ALL"))
def st_counts(spark, sf):
    path, schema = _stream_files(spark, sf)
    stream = ST.counts(spark.readStream.schema(schema).parquet(path), "artifact")
    return ST.run_to_end(stream, folder(spark, "counts"), folder(spark, "state"), "complete")


@query(
    "st_sessions",
    X.sql(", r AS (SELECT display_name, ms FROM ev WHERE ms IS NOT NULL UNION ALL SELECT display_name, ms FROM ev WHERE ms IS NOT NULL AND artifact = 'error'), c AS (SELECT *, CASE WHEN ms - lag(ms) OVER w >= 43200000 THEN 1 ELSE 0 END AS cut FROM r WINDOW w AS (PARTITION BY display_name ORDER BY ms)), g AS (SELECT *, sum(cut) OVER (PARTITION BY display_name ORDER BY ms) AS s FROM c) SELECT display_name, min(ms) AS start, max(ms) + 43200000 AS \"end\", count(*) AS n FROM g GROUP BY display_name, s"),
)
def st_sessions(spark, sf):
    path, schema = _stream_files(spark, sf)
    stream = ST.sessions(spark.readStream.schema(schema).parquet(path), "display_name", "12 hours")
    return ST.run_to_end(stream, folder(spark, "sessions"), folder(spark, "state"), "complete")


@query("effective_range", X.sql("SELECT source_id, min(ms + CASE source_id WHEN 'src-1' THEN 3600000 WHEN 'src-2' THEN -90500 ELSE 0 END) AS first_ms FROM ev GROUP BY source_id"))
def effective_range(spark, sf):
    """Per-source first times on corrected clocks."""
    return X.events(spark, sf).groupBy("source_id").agg(F.min(F.unix_millis(effective_time(X.OFFSETS))).alias("first_ms"))
