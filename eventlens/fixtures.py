"""The event table of the test data, as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.windows import AnalysisWindows, Window

#: Two suspect windows overlap on purpose.
WINDOWS = AnalysisWindows(Window("baseline", "2024-01-01", "2024-01-20"), (Window("w1", "2024-01-20", "2024-01-25"), Window("w2", "2024-01-24", "2024-01-31")))
MAPPINGS = {"client_ip": ["src_ip", "ip_addr"]}
OFFSETS = {"src-1": 3600.0, "src-2": -90.5}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "events")
    raw = raw.select("*", F.round(F.col("value") * 100).cast("long").alias("cents"), F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))
    eid, uid, cents, k = (F.col(c) for c in ("event_id", "user_id", "cents", "k"))
    text = lambda c: c.cast("string")
    ip = F.concat(F.lit("10.0."), text(uid % 200), F.lit("."), text(eid % 250))
    agent = F.concat(F.lit("Agent/"), text(k % 7))
    action = F.when((F.col("ts") >= F.lit("2024-01-22").cast("timestamp_ntz")) & (k < 20), "exfil").when(k % 3 == 0, "read").otherwise("write")
    size = F.when(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"), cents * 3).otherwise(cents)
    attributes = {
        "user": text(uid),
        "cents": text(cents),
        "k": text(k),
        "src_ip": F.when(uid % 4 < 2, ip),
        "ip_addr": F.when(uid % 4 >= 2, ip),
        "ua": F.when(eid % 199 == 0, F.concat(agent, F.lit(" é"), text(uid))).otherwise(F.concat(agent, F.lit("."), text(uid))),
        "session": F.when(eid % 70 == 0, F.md5(text(eid))).otherwise(F.concat(F.lit("sess-"), text(uid % 50), F.lit("-aaaa"))),
        "action": action,
        "bytes": text(size),
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in attributes.items()]), lambda p: p["value"].isNotNull())
    tags = F.filter(F.array(F.when(cents > 20000, "high"), F.when(k % 10 == 0, "tens")), lambda t: t.isNotNull())
    return raw.select(
        text(eid).alias("event_id"),
        F.lit("case-1").alias("case_id"),
        F.concat(F.lit("src-"), text(uid % 4)).alias("source_id"),
        F.lit("events.log").alias("source_file"),
        F.when(eid % 501 == 7, (eid - 40) * 128).otherwise(eid * 128).alias("byte_offset"),
        (eid + 1).alias("line_number"),
        F.concat(F.lit("user "), text(uid), F.lit(" "), F.col("event_type"), F.lit(" from "), ip, F.lit(" amount "), text(cents)).alias("message"),
        F.when(eid % 97 != 0, F.date_trunc("millisecond", F.col("ts").cast("timestamp"))).alias("timestamp"),
        F.lit("Event Time").alias("timestamp_desc"),
        F.col("event_type").alias("artifact"),
        F.lit("").alias("artifact_long"),
        F.concat(F.lit("user-"), text(uid)).alias("display_name"),
        tags.alias("tags"),
        F.map_from_entries(pairs).alias("attributes"),
    )


#: The same rows for DuckDB: ev (attributes as plain columns too, null where absent) and av (one row an attribute).
EV = """
e0 AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
e1 AS (SELECT *, '10.0.' || (user_id % 200) || '.' || (event_id % 250) AS ip FROM e0),
ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, 'case-1' AS case_id, 'src-' || (user_id % 4) AS source_id, 'events.log' AS source_file,
  CASE WHEN event_id % 501 = 7 THEN (event_id - 40) * 128 ELSE event_id * 128 END AS byte_offset, event_id + 1 AS line_number,
  'user ' || user_id || ' ' || event_type || ' from ' || ip || ' amount ' || cents AS message,
  CASE WHEN event_id % 97 <> 0 THEN date_trunc('millisecond', ts) END AS ts, CASE WHEN event_id % 97 <> 0 THEN epoch_ms(date_trunc('millisecond', ts)) END AS ms,
  'Event Time' AS timestamp_desc, event_type AS artifact, '' AS artifact_long, 'user-' || user_id AS display_name,
  list_filter([CASE WHEN cents > 20000 THEN 'high' END, CASE WHEN k % 10 = 0 THEN 'tens' END], lambda t: t IS NOT NULL) AS tags,
  CAST(user_id AS VARCHAR) AS a_user, CAST(cents AS VARCHAR) AS a_cents, CAST(k AS VARCHAR) AS a_k,
  CASE WHEN user_id % 4 < 2 THEN ip END AS a_src_ip, CASE WHEN user_id % 4 >= 2 THEN ip END AS a_ip_addr,
  'Agent/' || (k % 7) || CASE WHEN event_id % 199 = 0 THEN ' é' || user_id ELSE '.' || user_id END AS a_ua,
  CASE WHEN event_id % 70 = 0 THEN md5(CAST(event_id AS VARCHAR)) ELSE 'sess-' || (user_id % 50) || '-aaaa' END AS a_session,
  CASE WHEN ts >= TIMESTAMP '2024-01-22' AND k < 20 THEN 'exfil' WHEN k % 3 = 0 THEN 'read' ELSE 'write' END AS a_action,
  CAST(CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN cents * 3 ELSE cents END AS VARCHAR) AS a_bytes
  FROM e1),
av AS (SELECT event_id, source_id, ts, ms, p.k AS key, p.v AS val FROM (SELECT event_id, source_id, ts, ms, unnest([{'k': 'user', 'v': a_user}, {'k': 'cents', 'v': a_cents}, {'k': 'k', 'v': a_k}, {'k': 'src_ip', 'v': a_src_ip}, {'k': 'ip_addr', 'v': a_ip_addr}, {'k': 'ua', 'v': a_ua}, {'k': 'session', 'v': a_session}, {'k': 'action', 'v': a_action}, {'k': 'bytes', 'v': a_bytes}]) AS p FROM ev) WHERE p.v IS NOT NULL)"""


def sql(body: str) -> str:
    """A query over ev and av; body may begin with further named queries after a comma."""
    return f"WITH {EV.strip()}{body if body.lstrip().startswith(',') else ' ' + body}"
