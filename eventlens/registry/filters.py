"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import fields as FF
from ..plans import filters as P
from . import query

C = P.Condition


def row() -> list:
    return ["event_id", "source_id", F.coalesce(F.unix_millis("timestamp"), F.lit(-1)).alias("ms")]



def _filter(name: str, q: P.EventQuery, sql: str) -> None:
    query(name, X.sql(f"SELECT event_id, source_id, coalesce(ms, -1) AS ms FROM ev WHERE {sql}"))(lambda spark, sf: P.where(X.events(spark, sf), q).select(*row()))


ANY = "(message {0} OR timestamp_desc {0} OR artifact {0} OR display_name {0} OR source_file {0} OR len(list_filter(tags, lambda t: t {0})) > 0 OR EXISTS (SELECT 1 FROM av WHERE av.event_id = ev.event_id AND val {0}))"
_filter("f_scope", P.EventQuery(case_id="case-1", source_ids=("src-1", "src-3")), "case_id = 'case-1' AND source_id IN ('src-1', 'src-3')")
_filter("f_text", P.EventQuery(text="AGENT/3.1"), ANY.format("ILIKE '%agent/3.1%'"))
_filter("f_text_regex", P.EventQuery(text=r"sess-\d5-|(?P<n>error) from 10\.0\.1\d\.", text_regex=True), ANY.format("~ '(?s).*(sess-[0-9]5-|error from 10\\.0\\.1[0-9]\\.).*'"))
_filter("f_artifact", P.EventQuery(artifact="error", artifacts=("click",)), "artifact IN ('error', 'click')")
_filter("f_tag", P.EventQuery(tag="high"), "list_contains(tags, 'high')")
_filter("f_tag_not", P.EventQuery(tag_not="tens"), "NOT list_contains(tags, 'tens')")
_filter("f_time", P.EventQuery(start="2024-01-05 00:00:00", end="2024-01-07 12:30:00", offsets=X.OFFSETS), "ms + CASE source_id WHEN 'src-1' THEN 3600000 WHEN 'src-2' THEN -90500 ELSE 0 END BETWEEN epoch_ms(TIMESTAMP '2024-01-05') AND epoch_ms(TIMESTAMP '2024-01-07 12:30:00')")
_filter("f_exact", P.EventQuery(include=(C("artifact", ("error", "view")), C("attr:action", ("exfil",)))), "artifact IN ('error', 'view') AND a_action = 'exfil'")
_filter("f_wildcard", P.EventQuery(include=(C("ua", ("agent/?.1*",), "wildcard"),)), "a_ua ILIKE 'agent/_.1%'")
_filter("f_regex", P.EventQuery(include=(C("session", ("^[0-9a-f]{32}$",), "regex"),)), "regexp_matches(a_session, '^[0-9a-f]{32}$')")
_filter("f_empty", P.EventQuery(include=(C("src_ip", mode="empty"),)), "coalesce(a_src_ip, '') = ''")
_filter(
    "f_exclude",
    P.EventQuery(exclude=(C("artifact", ("click",)), C("ua", ("agent/0*",), "wildcard"), C("session", ("^sess-1",), "regex"), C("ip_addr", mode="empty"))),
    "artifact <> 'click' AND a_ua NOT ILIKE 'agent/0%' AND NOT regexp_matches(a_session, '^sess-1') AND coalesce(a_ip_addr, '') <> ''",
)
_filter("f_collapse_template", P.EventQuery(muted_templates=("user <NUM> error from <IP> amount <NUM>",)), "NOT regexp_matches(message, '^user [0-9]+ error from ')")
_filter("f_cursor", P.EventQuery(after=("2024-01-15 10:00:00", "5000")), "(ms < epoch_ms(TIMESTAMP '2024-01-15 10:00:00') OR (ms = epoch_ms(TIMESTAMP '2024-01-15 10:00:00') AND event_id > '5000'))")
_filter("f_cursor_before", P.EventQuery(before=("2024-01-15 10:00:00", "5000")), "(ms IS NULL OR ms > epoch_ms(TIMESTAMP '2024-01-15 10:00:00') OR (ms = epoch_ms(TIMESTAMP '2024-01-15 10:00:00') AND event_id < '5000'))")
_filter("f_cursor_undated", P.EventQuery(after=(None, "5")), "(ms IS NOT NULL OR event_id > '5')")
_filter("p_field", P.EventQuery(mappings=X.MAPPINGS, include=(C("client_ip", ("10.0.1*",), "wildcard"), C("time:day_of_week", ("1", "7")))), "coalesce(nullif(a_src_ip, ''), a_ip_addr) LIKE '10.0.1%' AND isodow(ts) IN (1, 7)")


def annotations(spark, sf):
    """(event_id, kind, value) made from the events: tags, anomalies and comments."""
    ev = X.events(spark, sf).select("event_id", F.col("event_id").cast("long").alias("n"))
    kind = F.when(F.col("n") % 3 == 0, "tag").when(F.col("n") % 3 == 1, "anomaly").otherwise("comment")
    value = F.when(F.col("n") % 6 == 0, "keep").when(F.col("n") % 2 == 0, "later").otherwise("why")
    return ev.where(F.col("n") % 113 < 2).select("event_id", kind.alias("kind"), value.alias("value"))


AN = """, an AS (SELECT event_id, CASE WHEN n % 3 = 0 THEN 'tag' WHEN n % 3 = 1 THEN 'anomaly' ELSE 'comment' END AS kind,
 CASE WHEN n % 6 = 0 THEN 'keep' WHEN n % 2 = 0 THEN 'later' ELSE 'why' END AS value FROM (SELECT event_id, CAST(event_id AS BIGINT) AS n FROM ev) WHERE n % 113 < 2)"""


def hits(spark, sf):
    """(event_id, label): rule hits."""
    return X.events(spark, sf).where(FF.attribute("action") == "exfil").where(F.col("artifact") == "error").select("event_id", F.lit("exfiltration").alias("label"))


HITS = ", hits AS (SELECT event_id, 'exfiltration' AS label FROM ev WHERE a_action = 'exfil' AND artifact = 'error')"


def routine(spark, sf):
    """(event_id, source_id, motif): members of routine motifs."""
    return X.events(spark, sf).where(F.col("line_number") % 7 < 2).select("event_id", "source_id", F.concat(F.lit("m"), (F.col("line_number") % 7).cast("string")).alias("motif"))


ROUTINE = ", routine AS (SELECT event_id, source_id, 'm' || (line_number % 7) AS motif FROM ev WHERE line_number % 7 < 2)"


@query("f_ids", X.sql(f"{AN} SELECT event_id, source_id, coalesce(ms, -1) AS ms FROM ev WHERE event_id IN (SELECT event_id FROM an)"))
def f_ids(spark, sf):
    return P.where(X.events(spark, sf), P.EventQuery(), ids=annotations(spark, sf)).select(*row())


@query("f_ids_not", X.sql(f"{AN} SELECT event_id, source_id, coalesce(ms, -1) AS ms FROM ev WHERE event_id NOT IN (SELECT event_id FROM an)"))
def f_ids_not(spark, sf):
    return P.where(X.events(spark, sf), P.EventQuery(), not_ids=annotations(spark, sf)).select(*row())


TAGGED = "(list_has_any(tags, ['high', 'keep', 'exfiltration']) OR event_id IN (SELECT event_id FROM an WHERE kind = 'tag' AND value IN ('high', 'keep', 'exfiltration')) OR event_id IN (SELECT event_id FROM hits WHERE label IN ('high', 'keep', 'exfiltration')))"


@query("f_tags_unified", X.sql(f"{AN}{HITS} SELECT event_id, source_id, coalesce(ms, -1) AS ms FROM ev WHERE {TAGGED}"))
def f_tags_unified(spark, sf):
    return P.by_tags(X.events(spark, sf), P.TagFilter(("high", "keep", "exfiltration")), annotations(spark, sf), hits(spark, sf)).select(*row())


@query("f_tags_unified_not", X.sql(f"{AN}{HITS} SELECT event_id, source_id, coalesce(ms, -1) AS ms FROM ev WHERE NOT ({TAGGED} OR event_id IN (SELECT event_id FROM an))"))
def f_tags_unified_not(spark, sf):
    return P.by_tags(X.events(spark, sf), P.TagFilter(("high", "keep", "exfiltration"), annotated=True, negate=True), annotations(spark, sf), hits(spark, sf)).select(*row())


@query("f_annotated", X.sql(f"{AN}{HITS} SELECT event_id, source_id, coalesce(ms, -1) AS ms FROM ev WHERE (event_id IN (SELECT event_id FROM an WHERE kind IN ('tag', 'anomaly')) OR event_id IN (SELECT event_id FROM hits)) AND event_id IN (SELECT event_id FROM ev WHERE source_id <> 'src-0')"))
def f_annotated(spark, sf):
    ev = X.events(spark, sf)
    ids = P.annotated_ids(annotations(spark, sf), hits(spark, sf), ev.where("source_id <> 'src-0'"))
    return P.where(ev, P.EventQuery(), ids=ids).select(*row())


@query("f_collapse_motif", X.sql(f"{ROUTINE} SELECT event_id, source_id, coalesce(ms, -1) AS ms FROM ev WHERE event_id NOT IN (SELECT event_id FROM routine)"))
def f_collapse_motif(spark, sf):
    return P.where(X.events(spark, sf), P.EventQuery(), routine=routine(spark, sf)).select(*row())


MUTED = ("user <NUM> error from <IP> amount <NUM>", "user <NUM> view from <IP> amount <NUM>")


@query("collapsed_count", X.sql(f"{ROUTINE} SELECT count(*) AS n FROM ev WHERE event_id IN (SELECT event_id FROM routine) OR artifact IN ('error', 'view')"))
def collapsed_count(spark, sf):
    return P.collapsed_count(X.events(spark, sf), routine(spark, sf), MUTED)


@query("motif_count", X.sql(f"{ROUTINE} SELECT count(DISTINCT event_id) AS n FROM routine WHERE motif = 'm1' AND source_id IN ('src-1', 'src-2')"))
def motif_count(spark, sf):
    return P.motif_count(routine(spark, sf), ["m1"], ["src-1", "src-2"])


@query("p_mapped", X.sql("SELECT event_id, coalesce(a_src_ip, a_ip_addr) AS client_ip, 'client_ip' AS derived FROM ev"))
def p_mapped(spark, sf):
    from ..operators.explore import derived_fields

    out = derived_fields(X.events(spark, sf), X.MAPPINGS)
    return out.select("event_id", FF.attribute("client_ip").alias("client_ip"), F.array_join("derived", ",").alias("derived"))


@query(
    "p_time",
    X.sql(
        "SELECT event_id, coalesce(strftime(ts, '%H'), '') AS hour_of_day, coalesce(CAST(isodow(ts) AS VARCHAR), '') AS day_of_week, coalesce(strftime(ts, '%d'), '') AS day_of_month, coalesce(lpad(CAST(week(ts) AS VARCHAR), 2, '0'), '') AS week_of_year, coalesce(strftime(ts, '%m'), '') AS month, coalesce(strftime(ts, '%Y-%m-%d'), '') AS date, coalesce(strftime(ts, '%Y-%m'), '') AS year_month FROM ev"
    ),
)
def p_time(spark, sf):
    return X.events(spark, sf).select("event_id", *[FF.time_part(p).alias(p) for p in FF.TIME_FIELDS])


@query("p_offset", X.sql("SELECT event_id, coalesce(ms + CASE source_id WHEN 'src-1' THEN 3600000 WHEN 'src-2' THEN -90500 ELSE 0 END, -1) AS ms FROM ev"))
def p_offset(spark, sf):
    return X.events(spark, sf).select("event_id", F.coalesce(F.unix_millis(FF.effective_time(X.OFFSETS)), F.lit(-1)).alias("ms"))


# Joins.
@query("j_semi_ids", X.sql(f"{AN} SELECT count(*) AS n, count(ms) AS dated FROM ev WHERE event_id IN (SELECT event_id FROM an)"))
def j_semi_ids(spark, sf):
    out = P.where(X.events(spark, sf), P.EventQuery(), ids=annotations(spark, sf))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("dated"))


@query("j_anti_routine", X.sql(f"{ROUTINE} SELECT source_id, count(*) AS n FROM ev WHERE event_id NOT IN (SELECT event_id FROM routine) GROUP BY source_id"))
def j_anti_routine(spark, sf):
    return P.where(X.events(spark, sf), P.EventQuery(), routine=routine(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("j_annotations", X.sql(f"{AN} SELECT event_id, count(value) AS n, coalesce(string_agg(kind || ':' || value, ',' ORDER BY kind || ':' || value), '') AS notes FROM ev LEFT JOIN an USING (event_id) GROUP BY event_id"))
def j_annotations(spark, sf):
    notes = annotations(spark, sf).groupBy("event_id").agg(F.count("value").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "value"))), ",").alias("notes"))
    out = X.events(spark, sf).select("event_id").join(notes, "event_id", "left")
    return out.select("event_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("notes", F.lit("")).alias("notes"))


@query("j_hydrate", X.sql("SELECT event_id, message, artifact, length(message) AS n FROM ev ORDER BY length(message) DESC, event_id LIMIT 20"))
def j_hydrate(spark, sf):
    from ..operators.explore import hydrate

    ev = X.events(spark, sf)
    keys = ev.select("event_id", F.length("message").cast("long").alias("n")).orderBy(F.desc("n"), "event_id").limit(20)
    return hydrate(keys, ev, ["message", "artifact"])
