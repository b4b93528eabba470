"""Counts, pages, fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import fields as FF
from ..operators import explore as O
from ..plans import filters as P
from . import SQL, query
from .filters import AN, HITS, annotations, hits


@query("count_events", X.sql("SELECT count(*) AS n FROM ev WHERE artifact = 'error' AND ms IS NOT NULL AND ms >= epoch_ms(TIMESTAMP '2024-01-05')"))
def count_events(spark, sf):
    return P.where(X.events(spark, sf), P.EventQuery(artifact="error", start="2024-01-05 00:00:00")).agg(F.count(F.lit(1)).alias("n"))


@query("time_range", X.sql("SELECT min(ms) AS first_ms, max(ms) AS last_ms, CAST(floor((min(ms) + max(ms)) / 2) AS BIGINT) AS middle_ms FROM ev"))
def time_range(spark, sf):
    return O.time_range(X.events(spark, sf))


@query("terms", X.sql(", c AS (SELECT a_ua AS value, count(*) AS n FROM ev GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 50) SELECT value, n, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total, (SELECT count(*) FROM c) AS n_distinct, CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM t) AS BIGINT) AS other FROM t"))
def terms(spark, sf):
    return O.terms(X.events(spark, sf), "ua", 50)


@query("list_fields", X.sql("SELECT key AS field FROM (SELECT DISTINCT key FROM av WHERE key NOT IN ('src_ip', 'ip_addr')) UNION SELECT 'client_ip'"))
def list_fields(spark, sf):
    return O.list_fields(X.events(spark, sf), X.MAPPINGS)


@query("list_artifacts", X.sql("SELECT DISTINCT artifact FROM ev"))
def list_artifacts(spark, sf):
    return X.events(spark, sf).select("artifact").distinct()


@query("list_tags", X.sql("SELECT DISTINCT unnest(tags) AS tag FROM ev"))
def list_tags(spark, sf):
    return O.distinct_tags(X.events(spark, sf))


@query("list_tags_merged", X.sql(f"{AN}{HITS} SELECT unnest(tags) AS tag FROM ev UNION SELECT value FROM an WHERE kind = 'tag' UNION SELECT label FROM hits"))
def list_tags_merged(spark, sf):
    return O.merged_tags(X.events(spark, sf), annotations(spark, sf), hits(spark, sf))


@query(
    "field_coverage",
    X.sql(
        ", r AS (SELECT event_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY md5(event_id), event_id) AS n FROM ev), v AS (SELECT r.source_id, key, val FROM av JOIN r USING (event_id) WHERE n <= 1000) SELECT source_id, key, count(*) AS n, array_to_string(list_sort(list_distinct(list(val)))[1:3], '|') AS samples FROM v GROUP BY 1, 2"
    ),
)
def field_coverage(spark, sf):
    return O.field_coverage(X.events(spark, sf), 1000)


@query("field_coverage_full", SQL["field_coverage"].replace("n <= 1000", "n <= 20000"))
def field_coverage_full(spark, sf):
    """At the reference's 20,000 rows a source."""
    return O.field_coverage(X.events(spark, sf), 20_000)


@query(
    "field_stats",
    X.sql(
        """, c AS (SELECT source_id, key, val, count(*) AS n FROM av GROUP BY ALL), k AS (SELECT source_id, key, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS coverage, CAST(max(length(val)) AS INTEGER) AS longest, min(val) AS sample FROM c GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY source_id, key ORDER BY n DESC, val) AS r FROM c)
        SELECT k.*, (SELECT string_agg(val || '=' || n, '|' ORDER BY r) FROM t WHERE t.source_id = k.source_id AND t.key = k.key AND r <= 50) AS top_values, false AS capped FROM k"""
    ),
)
def field_stats(spark, sf):
    return O.field_stats(X.events(spark, sf))


STATS = ", s AS (SELECT source_id, key, count(DISTINCT val) AS n_distinct, count(*) AS coverage, CAST(max(length(val)) AS INTEGER) AS longest, sum(length(val)) AS chars FROM av GROUP BY ALL)"


@query("field_stats_merge", X.sql(f"{STATS} SELECT key, CAST(sum(coverage) AS BIGINT) AS coverage, max(n_distinct) AS n_distinct, max(longest) AS longest, count(*) AS n_sources FROM s GROUP BY key"))
def field_stats_merge(spark, sf):
    return O.merge_field_stats(O.field_stats(X.events(spark, sf)))


@query(
    "viz_fields",
    X.sql(f"{STATS} SELECT key AS field, CAST(sum(coverage) AS BIGINT) AS coverage, max(n_distinct) AS n_distinct, 0 AS is_time FROM s GROUP BY key UNION ALL SELECT 'time:' || unnest(['hour_of_day', 'day_of_week', 'day_of_month', 'week_of_year', 'month', 'date', 'year_month']), 0, 0, 1"),
)
def viz_fields(spark, sf):
    return O.viz_fields(O.field_stats(X.events(spark, sf)))


@query(
    "embed_fields",
    X.sql(
        r""", r AS (SELECT event_id, artifact, row_number() OVER (PARTITION BY artifact, source_id ORDER BY md5(event_id), event_id) AS n FROM ev),
        v AS (SELECT r.artifact, key, val FROM av JOIN r USING (event_id) WHERE n <= 500),
        s AS (SELECT artifact, key, count(*) AS n, count(DISTINCT val) AS n_distinct, avg(CAST(regexp_matches(val, '^\{?[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}?$') AS INT)) AS guid, avg(CAST(regexp_matches(val, '^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$') AS INT)) AS hash, avg(CAST(regexp_matches(val, '^[0-9]+$') AS INT)) AS num, avg(length(val)) AS len FROM v GROUP BY ALL)
        SELECT artifact, key, n, n_distinct, CASE WHEN guid >= 0.9 THEN 'guid' WHEN hash >= 0.9 THEN 'hash' WHEN n_distinct = 1 THEN 'constant' WHEN num >= 0.9 THEN 'numeric' WHEN n_distinct >= 0.95 * n AND len < 40 THEN 'id' ELSE 'text' END AS kind FROM s"""
    ),
)
def embed_fields(spark, sf):
    return O.classify_fields(X.events(spark, sf), 500)


@query("embed_fields_full", SQL["embed_fields"].replace("n <= 500", "n <= 2000"))
def embed_fields_full(spark, sf):
    """At the operator's 2,000 rows of an artifact and source."""
    return O.classify_fields(X.events(spark, sf))


@query(
    "column_score",
    X.sql(
        """, s AS (SELECT key, count(*) AS coverage, count(DISTINCT val) AS d, count(DISTINCT source_id) AS src, avg(length(val)) AS len FROM av GROUP BY key), t AS (SELECT (SELECT count(*) FROM ev) AS total, (SELECT count(DISTINCT source_id) FROM ev) AS sources),
        x AS (SELECT key, round(CASE WHEN d <= 1 OR d / coverage >= 0.95 OR len > 120 THEN 0 ELSE (3 * src / sources + 2 * coverage / total + (1 - d / coverage) + CASE WHEN regexp_matches(key, '(user|host|ip|status|action|method|path|uri|url|process|command|name|port|domain|type|level|event)') THEN 1 ELSE 0 END) / 7 END, 6) AS score FROM s, t)
        SELECT key, CAST(score AS DOUBLE) AS score, score >= 0.35 AS shown FROM x"""
    ),
)
def column_score(spark, sf):
    ev = X.events(spark, sf)
    each = O.pairs(ev)
    stats = each.groupBy("key").agg(F.count(F.lit(1)).alias("coverage"), F.countDistinct("val").alias("n_distinct"), F.countDistinct("source_id").alias("n_sources"), F.avg(F.length("val")).alias("mean_length"))
    one = ev.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("s")).first()
    return O.column_scores(stats, one.n, one.s)


@query("describe_field", X.sql("SELECT true AS found, count(*) AS n, count(DISTINCT a_bytes) AS n_distinct, count(*) AS n_numeric, min(CAST(a_bytes AS DOUBLE)) AS lo, max(CAST(a_bytes AS DOUBLE)) AS hi, round(avg(CAST(a_bytes AS DOUBLE)), 6) AS mean, 'linear' AS scale FROM ev"))
def describe_field(spark, sf):
    return O.describe_field(X.events(spark, sf), "bytes")


@query("page", X.sql("SELECT event_id, coalesce(ms, -1) AS ms, message, row_number() OVER (ORDER BY ms DESC NULLS FIRST, event_id) AS place, true AS more FROM ev WHERE artifact = 'error' ORDER BY place LIMIT 50"))
def page(spark, sf):
    return O.page(P.where(X.events(spark, sf), P.EventQuery(artifact="error")), 50).select("event_id", F.coalesce(F.unix_millis("timestamp"), F.lit(-1)).alias("ms"), "message", F.col("place").cast("long").alias("place"), "more")


@query("export_scan", X.sql("SELECT event_id, coalesce(ms, -1) AS ms, artifact, message FROM ev WHERE list_contains(tags, 'tens')"))
def export_scan(spark, sf):
    return P.where(X.events(spark, sf), P.EventQuery(tag="tens")).orderBy(*O.newest_first()).select("event_id", F.coalesce(F.unix_millis("timestamp"), F.lit(-1)).alias("ms"), "artifact", "message")


@query("event_refs", X.sql("SELECT event_id, source_id FROM ev WHERE artifact = 'click' ORDER BY event_id LIMIT 100"))
def event_refs(spark, sf):
    """References of the first 100 matching events, as its SQL; event_refs_all has every one."""
    return P.where(X.events(spark, sf), P.EventQuery(artifact="click")).select("event_id", "source_id").orderBy("event_id").limit(100)


@query("event_refs_all", X.sql("SELECT event_id, source_id FROM ev WHERE artifact = 'click'"))
def event_refs_all(spark, sf):
    """References of all matching events for bulk tagging."""
    return P.where(X.events(spark, sf), P.EventQuery(artifact="click")).select("event_id", "source_id")


@query("attr_keys_present", X.sql("SELECT key, count(*) AS n FROM av WHERE key IN ('src_ip', 'ua', 'nothing') GROUP BY key"))
def attr_keys_present(spark, sf):
    return O.keys_present(X.events(spark, sf), ["src_ip", "ua", "nothing"])


@query("attr_clean", X.sql("SELECT event_id, array_to_string(list_sort(list(key || '=' || val)), ';') AS attributes FROM av GROUP BY event_id"))
def attr_clean(spark, sf):
    from ..functions.normalize import clean_attributes

    dirty = X.events(spark, sf).withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("blank"), F.lit(""), F.lit("none"), F.lit(None).cast("string"))))
    out = dirty.select("event_id", clean_attributes(F.col("attributes")).alias("m"))
    return out.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("attributes"))


@query("template_mask", X.sql("SELECT event_id, regexp_replace(regexp_replace(message, '10\\.0\\.[0-9]+\\.[0-9]+', '<IP>'), '[0-9]+', '<NUM>', 'g') AS template FROM ev WHERE NOT regexp_matches(message, '[0-9a-f]{8}')"))
def template_mask(spark, sf):
    ev = X.events(spark, sf).where(~F.col("message").rlike("[0-9a-f]{8}"))
    return ev.select("event_id", FF.template(F.col("message")).alias("template"))
