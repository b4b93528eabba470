"""Rules, enrichment, similarity, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import fields as FF
from ..functions import normalize as N
from ..operators import detect as D
from ..operators import enrich as E
from ..operators import rules as R
from ..operators import similarity as S
from ..operators import verdicts as V
from . import query
from .filters import AN, annotations


def _rule(name: str, selections: dict, condition: str, sql: str, mappings=None) -> None:
    rule = {"selections": selections, "condition": condition}
    query(name, X.sql(f"SELECT event_id, '{name}' AS rule FROM ev WHERE {sql}"))(lambda spark, sf: R.scan(X.events(spark, sf), {name: rule}, mappings)[0])


_rule("r_string", {"a": {"artifact": "ERR*", "ua|contains": "/3."}, "b": {"session|startswith|cased": "Sess"}}, "a and not b", "artifact ILIKE 'err%' AND a_ua ILIKE '%/3.%' AND a_session NOT LIKE 'Sess%'")
_rule("r_number", {"a": {"k": [7, 70]}, "b": {"missing": False}}, "a and not b", "a_k IN ('7', '70')")
_rule("r_compare", {"a": {"bytes|gte": 30000}, "b": {"k|lt": 10}}, "a or b", "CAST(a_bytes AS DOUBLE) >= 30000 OR CAST(a_k AS DOUBLE) < 10")
_rule("r_regex", {"a": {"session|re|i": "^SESS-(1|2)[0-9]-"}}, "a", "regexp_matches(a_session, '^sess-(1|2)[0-9]-')")
_rule("r_cidr", {"a": {"client_ip|cidr": ["10.0.16.0/20", "10.0.1.128/25"]}}, "a", "CAST(split_part(coalesce(a_src_ip, a_ip_addr), '.', 3) AS INT) BETWEEN 16 AND 31 OR (split_part(coalesce(a_src_ip, a_ip_addr), '.', 3) = '1' AND CAST(split_part(coalesce(a_src_ip, a_ip_addr), '.', 4) AS INT) >= 128)", X.MAPPINGS)
_rule("r_null", {"a": {"src_ip": None}, "b": {"ip_addr|exists": True}}, "all of them", "a_src_ip IS NULL AND a_ip_addr IS NOT NULL")
_rule("r_keyword", {"kw": ["EXFIL", "agent/6.1*"], "b": {"artifact": "error"}}, "1 of kw* and b", "(a_action = 'exfil' OR a_ua ILIKE '%agent/6.1%') AND artifact = 'error'")

RULES = {
    "exfil": {"selections": {"a": {"action": "exfil"}}, "condition": "a"},
    "large": {"selections": {"a": {"bytes|gt": 60000}, "b": {"artifact": ["error", "view"]}}, "condition": "a and b"},
    "never": {"selections": {"a": {"action": "nothing"}}, "condition": "a"},
    "other": {"selections": {"a": {"absent_key": "x"}}, "condition": "a"},
    "broken": {"selections": {"a": {"action|nonsense": "x"}}, "condition": "a"},
}
HIT = ", h AS (SELECT event_id, 'exfil' AS rule FROM ev WHERE a_action = 'exfil' UNION ALL SELECT event_id, 'large' FROM ev WHERE CAST(a_bytes AS DOUBLE) > 60000 AND artifact IN ('error', 'view'))"


@query("r_scan", X.sql(f"{HIT} SELECT * FROM h"))
def r_scan(spark, sf):
    return R.scan(X.events(spark, sf), RULES)[0]


@query(
    "r_scan_status",
    X.sql(f"{HIT} SELECT r AS rule, CASE r WHEN 'broken' THEN 'error' WHEN 'other' THEN 'not_applicable' ELSE CASE WHEN count(rule) > 0 THEN 'matched' ELSE 'empty' END END AS status, count(rule) AS n FROM (SELECT unnest(['exfil', 'large', 'never', 'other', 'broken']) AS r) LEFT JOIN h ON rule = r GROUP BY r"),
)
def r_scan_status(spark, sf):
    return R.status(spark, X.events(spark, sf), RULES)


@query(
    "r_annotate",
    X.sql(
        f"{HIT}, o AS (SELECT event_id, 'exfil' AS rule, CAST(event_id AS BIGINT) % 2 = 0 AS confirmed FROM ev WHERE CAST(event_id AS BIGINT) % 100 < 3 UNION ALL SELECT event_id, 'older', false FROM ev WHERE CAST(event_id AS BIGINT) % 500 = 0) SELECT * FROM o WHERE confirmed OR rule NOT IN (SELECT rule FROM h) UNION ALL SELECT event_id, rule, false FROM h ANTI JOIN (SELECT event_id, rule FROM o WHERE confirmed) USING (event_id, rule)"
    ),
)
def r_annotate(spark, sf):
    ev = X.events(spark, sf)
    n = F.col("event_id").cast("long")
    old = ev.where(n % 100 < 3).select("event_id", F.lit("exfil").alias("rule"), (n % 2 == 0).alias("confirmed")).unionByName(ev.where(n % 500 == 0).select("event_id", F.lit("older").alias("rule"), F.lit(False).alias("confirmed")))
    return R.annotate(old, R.scan(ev, RULES)[0])


# Enrichment.
def ranges(spark, sf):
    """(lo, hi, zone, asn): address ranges made from the users' addresses."""
    base = X.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i"), "n_name")
    lo = F.lit(10 * 2**24) + F.col("i") * 8 * 256
    return base.select(lo.alias("lo"), (lo + 8 * 256 - 1 - F.when(F.col("i") % 5 == 0, 128).otherwise(0)).alias("hi"), F.col("n_name").alias("zone"), (F.col("i") + 64500).cast("long").alias("asn"))


RG = """, rg AS (SELECT 167772160 + n_nationkey * 2048 AS lo, 167772160 + n_nationkey * 2048 + 2047 - CASE WHEN n_nationkey % 5 = 0 THEN 128 ELSE 0 END AS hi, n_name AS zone, CAST(n_nationkey + 64500 AS BIGINT) AS asn FROM nation),
 iv AS (SELECT event_id, key, val, 167772160 + CAST(split_part(val, '.', 3) AS BIGINT) * 256 + CAST(split_part(val, '.', 4) AS BIGINT) AS ip FROM av WHERE key IN ('src_ip', 'ip_addr'))"""


@query("enrich_eligible", X.sql("SELECT count(*) > 0 AS eligible FROM av WHERE regexp_matches(val, '^10\\.0\\.')"))
def enrich_eligible(spark, sf):
    return E.eligible(X.events(spark, sf), N.IPV4)


@query("enrich_geoip", X.sql(f"{RG} SELECT DISTINCT val, zone FROM iv JOIN rg ON ip BETWEEN lo AND hi"))
def enrich_geoip(spark, sf):
    return E.ranges_of(E.address_values(X.events(spark, sf)), ranges(spark, sf), ["zone"])


@query("enrich_asn", X.sql(f"{RG} SELECT DISTINCT val, asn FROM iv JOIN rg ON ip BETWEEN lo AND hi"))
def enrich_asn(spark, sf):
    return E.ranges_of(E.address_values(X.events(spark, sf)), ranges(spark, sf), ["asn"])


@query("j_range_geo", X.sql(f"{RG} SELECT zone, count(*) AS n, count(DISTINCT val) AS addresses FROM iv JOIN rg ON ip BETWEEN lo AND hi GROUP BY zone"))
def j_range_geo(spark, sf):
    ev = X.events(spark, sf)
    found = E.ranges_of(E.address_values(ev), ranges(spark, sf), ["zone"])
    each = ev.select(F.explode("attributes").alias("key", "val")).where(F.col("key").isin("src_ip", "ip_addr"))
    return each.join(found, "val").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("val").alias("addresses"))


def _flat(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


@query("enrich_values", X.sql(f"{RG} SELECT event_id, string_agg(key || ':asn=' || asn || ';' || key || ':zone=' || zone, ';') AS made FROM iv JOIN rg ON ip BETWEEN lo AND hi GROUP BY event_id"))
def enrich_values(spark, sf):
    ev = X.events(spark, sf)
    found = E.ranges_of(E.address_values(ev), ranges(spark, sf), ["zone", "asn"])
    return E.enrichment(ev, found, ["zone", "asn"]).select("event_id", _flat(F.col("made")).alias("made"))


@query("enrich_apply", X.sql(f"{RG}, m AS (SELECT event_id, key || ':zone' AS key, zone AS val FROM iv JOIN rg ON ip BETWEEN lo AND hi), u AS (SELECT event_id, key, val FROM av UNION ALL SELECT * FROM m) SELECT event_id, array_to_string(list_sort(list(key || '=' || val)), ';') AS attributes FROM u GROUP BY event_id"))
def enrich_apply(spark, sf):
    """A second run over rows that hold a stale derived key leaves nothing of it."""
    ev = X.events(spark, sf).withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("old:zone"), F.lit("stale"))))
    found = E.ranges_of(E.address_values(ev), ranges(spark, sf), ["zone"])
    out = E.apply_enrichment(ev, E.enrichment(ev, found, ["zone"]), ["zone"])
    return out.select("event_id", _flat(F.col("attributes")).alias("attributes"))


@query("j_left_enrich", X.sql(f"{RG}, m AS (SELECT event_id, count(*) AS n FROM iv JOIN rg ON ip BETWEEN lo AND hi GROUP BY event_id) SELECT coalesce(n, 0) AS derived, count(*) AS events FROM ev LEFT JOIN m USING (event_id) GROUP BY 1"))
def j_left_enrich(spark, sf):
    """Events by how many keys the left join with grouped lookups adds."""
    ev = X.events(spark, sf)
    found = E.ranges_of(E.address_values(ev), ranges(spark, sf), ["zone"])
    joined = ev.select("event_id").join(E.enrichment(ev, found, ["zone"]), "event_id", "left")
    return joined.groupBy(F.coalesce(F.size("made"), F.lit(0)).cast("long").alias("derived")).agg(F.count(F.lit(1)).alias("events"))


# Similarity.
NORMED = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v)"


@query("sim_event", f"{NORMED}, q AS (SELECT e, l FROM n WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(n.e, q.e) / (n.l * q.l), 6) AS score FROM n, q WHERE vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 10")
def sim_event(spark, sf):
    return S.nearest_to_event(X.read(spark, sf, "embeddings"), 7, 10)[1]


@query("sim_vector", f"{NORMED} SELECT vec_id, round(list_dot_product(e, list_transform(range(len(e)), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE -0.5 END)) / (l * sqrt(list_sum(list_transform(range(len(e)), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE 0.25 END)))), 6) AS score FROM n ORDER BY 2 DESC, 1 LIMIT 10")
def sim_vector(spark, sf):
    return S.nearest_to_vector(X.read(spark, sf, "embeddings"), [1.0 if i % 2 == 0 else -0.5 for i in range(64)], 10)


@query("sim_hydrate", X.sql(", v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 7), t AS (SELECT vec_id, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM v, q WHERE vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 10) SELECT event_id, message, score FROM t JOIN ev ON event_id = CAST(vec_id AS VARCHAR)"))
def sim_hydrate(spark, sf):
    hits = S.nearest_to_event(X.read(spark, sf, "embeddings"), 7, 10)[1]
    return X.events(spark, sf).select("event_id", "message").join(F.broadcast(hits.select(F.col("vec_id").cast("string").alias("event_id"), "score")), "event_id")  # ten hits


@query("emb_text", X.sql("SELECT event_id, concat_ws(' | ', 'message=' || message, 'artifact=' || artifact, 'action=' || a_action, 'k=' || a_k, CASE WHEN len(tags) > 0 THEN array_to_string(list_transform(list_sort(tags), lambda t: 'tag=' || t), ' | ') END) AS text FROM ev"))
def emb_text(spark, sf):
    return S.embedding_text(X.events(spark, sf), ["k", "action"])


CENTER = "WITH p AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY ALL), c AS (SELECT label, list(x ORDER BY pos) AS e, sqrt(sum(x * x)) AS l FROM m GROUP BY label)"


@query("emb_centroid", f"{CENTER} SELECT label, round(list_sum(list_transform(e, lambda x: x / l)), 6) AS total, round(e[1] / l, 6) AS first, len(e) AS n FROM c")
def emb_centroid(spark, sf):
    out = S.centroids(X.read(spark, sf, "embeddings"), "label")
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return out.select("label", F.round(total, 6).alias("total"), F.round(F.get("centroid", 0), 6).alias("first"), F.size("centroid").cast("long").alias("n"))


@query("emb_cohesion", f"{CENTER}, k AS (SELECT avg(list_dot_product(a.e, b.e) / (a.l * b.l)) AS c, count(*) AS pairs FROM c a JOIN c b ON a.label < b.label) SELECT round(c, 6) AS cohesion, pairs, CASE WHEN c >= 0.7 THEN 'strong' WHEN c >= 0.5 THEN 'moderate' ELSE 'weak' END AS level FROM k")
def emb_cohesion(spark, sf):
    return S.cohesion(S.centroids(X.read(spark, sf, "embeddings"), "label"), "label")


@query("emb_groups", f"WITH RECURSIVE {CENTER[5:]}, k AS (SELECT a.label AS a, b.label AS b FROM c a JOIN c b ON a.label <> b.label AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.05), r AS (SELECT label AS a, label AS root FROM c UNION SELECT k.a, r.root FROM k JOIN r ON k.b = r.a) SELECT a AS label, min(root) AS root FROM r GROUP BY a")
def emb_groups(spark, sf):
    return S.groups(S.centroids(X.read(spark, sf, "embeddings"), "label"), "label", 0.05)


# Verdicts.
def dispositions(spark, sf):
    """(field, value, event_id, detector, kind, at): analysts' verdicts made from the events."""
    ev = X.events(spark, sf).where("timestamp IS NOT NULL")
    n = F.col("event_id").cast("long")
    kind = F.when(n % 3 == 0, "normal").when(n % 3 == 1, "dismissed").otherwise("confirmed")
    own = ev.where(n % 37 == 5)
    by_value = own.where(n % 2 == 0)
    a = by_value.select(F.lit("ua").alias("field"), FF.attribute("ua").alias("value"), F.lit(None).cast("string").alias("event_id"), F.lit("*").alias("detector"), kind.alias("kind"), F.col("timestamp").alias("at"))
    b = own.where(n % 2 == 1).select(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), "event_id", F.lit("value_novelty").alias("detector"), kind.alias("kind"), F.col("timestamp").alias("at"))
    return a.unionByName(b)


DI = """, d0 AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev WHERE ts IS NOT NULL AND CAST(event_id AS BIGINT) % 37 = 5), di AS (SELECT CASE WHEN n % 2 = 0 THEN 'ua' END AS field, CASE WHEN n % 2 = 0 THEN a_ua END AS value, CASE WHEN n % 2 = 1 THEN event_id END AS event_id, CASE n % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'dismissed' ELSE 'confirmed' END AS kind, ts AS seen FROM d0),
 fd AS (SELECT 'ua' AS field, a_ua AS value, count(*) AS n, min(event_id) AS event_id FROM ev GROUP BY a_ua)"""


def findings(spark, sf):
    return X.events(spark, sf).groupBy(F.lit("ua").alias("field"), FF.attribute("ua").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id"))


@query("bulk_annotate", X.sql(f"{AN} SELECT * FROM an UNION ALL SELECT event_id, 'tag', 'bulk' FROM ev WHERE list_contains(tags, 'high')"))
def bulk_annotate(spark, sf):
    return V.bulk_annotate(X.events(spark, sf).where(F.array_contains("tags", "high")), annotations(spark, sf), "tag", "bulk")


@query("persist_findings", X.sql(f"{DI}, o AS (SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 4 < 2 THEN 'value_novelty' ELSE 'other' END AS detector, CAST(event_id AS BIGINT) % 4 % 2 = 0 AS confirmed FROM ev WHERE CAST(event_id AS BIGINT) % 50 < 4), k AS (SELECT * FROM o WHERE detector <> 'value_novelty' OR confirmed) SELECT * FROM k UNION ALL SELECT DISTINCT event_id, 'value_novelty', false FROM fd WHERE event_id NOT IN (SELECT event_id FROM k WHERE detector = 'value_novelty')"))
def persist_findings(spark, sf):
    n = F.col("event_id").cast("long")
    old = X.events(spark, sf).where(n % 50 < 4).select("event_id", F.when(n % 4 < 2, "value_novelty").otherwise("other").alias("detector"), (n % 4 % 2 == 0).alias("confirmed"))
    return V.persist_findings(old, findings(spark, sf), "value_novelty")


@query("disp_normal", X.sql(f"{DI} SELECT * FROM fd WHERE NOT EXISTS (SELECT 1 FROM di WHERE kind = 'normal' AND di.field = fd.field AND di.value = fd.value) AND event_id NOT IN (SELECT event_id FROM di WHERE kind = 'normal' AND event_id IS NOT NULL)"))
def disp_normal(spark, sf):
    return V.without_normal(findings(spark, sf), dispositions(spark, sf), "value_novelty").select("field", "value", "n", "event_id")


FLAG = ", fl AS (SELECT fd.*, EXISTS (SELECT 1 FROM di WHERE di.value = fd.value AND kind = 'dismissed') AS dismissed, EXISTS (SELECT 1 FROM di WHERE di.value = fd.value AND kind = 'confirmed') AS confirmed FROM fd)"


@query("disp_dismissed", X.sql(f"{DI}{FLAG} SELECT value, n, (SELECT count(*) FROM fl WHERE dismissed) AS hidden FROM fl WHERE NOT dismissed"))
def disp_dismissed(spark, sf):
    shown, count = V.visible(findings(spark, sf), dispositions(spark, sf))
    return shown.crossJoin(F.broadcast(count.withColumnRenamed("dismissed", "hidden"))).select("value", "n", "hidden")


@query("disp_confirmed", X.sql(f"{DI}{FLAG} SELECT value, n, dismissed, confirmed FROM fl"))
def disp_confirmed(spark, sf):
    return V.with_verdicts(findings(spark, sf), dispositions(spark, sf)).select("value", "n", "dismissed", "confirmed")


@query("disp_stats", X.sql(f"{DI}, c AS (SELECT strftime(seen, '%Y-%m-%d') AS day, count_if(kind = 'normal') AS normal, count_if(kind = 'dismissed') AS dismissed, count_if(kind = 'confirmed') AS confirmed FROM di GROUP BY 1) SELECT day, CAST(normal AS BIGINT) AS normal, CAST(dismissed AS BIGINT) AS dismissed, CAST(confirmed AS BIGINT) AS confirmed, CAST(sum(normal + dismissed + confirmed) OVER (ORDER BY day) AS BIGINT) AS total FROM c"))
def disp_stats(spark, sf):
    return V.disposition_stats(dispositions(spark, sf))


@query("run_snapshot")
def run_snapshot(spark, sf):
    """No SQL: hashes of canonical JSON; tests hold them."""
    found = D.value_novelty(X.events(spark, sf), ["ua"])
    return V.snapshot(found, "value_novelty", {"fields": ["ua"]}, {"baseline": [X.WINDOWS.baseline.start, X.WINDOWS.baseline.end]}, dispositions(spark, sf))
