"""Statuses and warnings of detectors over an empty, a thin and the whole scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import diagnose as G
from . import query

W = X.WINDOWS
SCOPES = """, sc AS (SELECT 'empty' AS scope, * FROM ev WHERE false UNION ALL SELECT 'thin', * FROM ev WHERE CAST(event_id AS BIGINT) % 500 = 3 UNION ALL SELECT 'whole', * FROM ev),
 b AS (SELECT *, ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20' AS base, ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-25' AS in1, ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' AS in2 FROM sc),
 n AS (SELECT s.scope, count(event_id) AS total, count(*) FILTER (base) AS base, count(*) FILTER (in1) AS w1, count(*) FILTER (in2) AS w2, count(ts) AS dated FROM (SELECT unnest(['empty', 'thin', 'whole']) AS scope) AS s LEFT JOIN b USING (scope) GROUP BY s.scope)"""


def _scopes(spark, sf):
    ev = X.events(spark, sf)
    return {"empty": ev.where("false"), "thin": ev.where(F.col("event_id").cast("long") % 500 == 3), "whole": ev}


def _every(spark, sf, detectors, part):
    """The parts of all outcomes, one under the other."""
    made = [part(f(df)).withColumn("scope", F.lit(scope)) for scope, df in _scopes(spark, sf).items() for f in detectors]
    return reduce(lambda a, b: a.unionByName(b), made)


@query(
    "d_status",
    X.sql(
        f"""{SCOPES} SELECT scope, 'numeric_range' AS detector, CASE WHEN total = 0 THEN 'no_data' WHEN base < 20 THEN 'insufficient_data' ELSE 'ok' END AS status, total, base AS baseline FROM n
        UNION ALL SELECT scope, 'proportion_shift', CASE WHEN total = 0 THEN 'no_data' WHEN base = 0 THEN 'insufficient_data' ELSE 'ok' END, total, base FROM n
        UNION ALL SELECT scope, 'distribution_drift', CASE WHEN total = 0 THEN 'no_data' WHEN base = 0 OR least(base, greatest(w1, w2)) < 20 THEN 'insufficient_data' ELSE 'ok' END, total, base FROM n
        UNION ALL SELECT scope, 'timestamp_order', CASE WHEN dated = 0 THEN 'no_data' ELSE 'ok' END, dated, dated FROM n"""
    ),
)
def d_status(spark, sf):
    detectors = [lambda d: G.numeric_range(d, ["bytes"], W), lambda d: G.proportion_shift(d, ["action"], W), lambda d: G.drift(d, ["bytes"], ["action"], W), G.timestamp_order]
    return _every(spark, sf, detectors, lambda o: o.summary().select("detector", "status", "total", "baseline"))


@query(
    "d_warnings",
    X.sql(
        f"""{SCOPES}, wn AS (SELECT scope, base, unnest(['w1', 'w2']) AS label, unnest([w1, w2]) AS n FROM n WHERE total > 0),
        g AS (SELECT scope, display_name AS name, count(DISTINCT CASE WHEN base THEN a_session END) AS k FROM b WHERE a_session <> '' AND (base OR in1 OR in2) GROUP BY ALL),
        back AS (SELECT scope, count(DISTINCT a_session) AS n_back FROM b WHERE base GROUP BY scope)
        SELECT scope, 'numeric_range' AS detector, 'small_window' AS kind, NULL AS field, NULL AS name, label, n FROM wn WHERE n < 50
        UNION ALL SELECT scope, 'numeric_range', 'thin_field', 'bytes', NULL, NULL, base FROM n WHERE total > 0 AND base < 20
        UNION ALL SELECT scope, 'distribution_drift', 'small_window', NULL, NULL, label, n FROM wn WHERE n < 50
        UNION ALL SELECT scope, 'distribution_drift', 'skipped_test', unnest(['bytes', 'action']), NULL, label, least(base, n) FROM wn WHERE least(base, n) < 20 AND base + n > 0
        UNION ALL SELECT scope, 'distribution_drift', 'no_baseline', NULL, NULL, 'baseline', 0 FROM n WHERE total > 0 AND base = 0
        UNION ALL SELECT scope, 'distribution_drift', 'absent_field', unnest(['bytes', 'action']), NULL, NULL, 0 FROM n WHERE total > 0 AND base = 0
        UNION ALL SELECT scope, 'numeric_range', 'no_baseline', NULL, NULL, 'baseline', 0 FROM n WHERE total > 0 AND base = 0
        UNION ALL SELECT scope, 'charset', 'small_window', NULL, NULL, label, n FROM wn WHERE n < 50
        UNION ALL SELECT scope, 'charset', CASE WHEN coalesce(n_back, 0) < 20 THEN 'unmeasured_group' WHEN k = 0 THEN 'absent_group' ELSE 'thin_group' END, 'session', name, NULL, k FROM g LEFT JOIN back USING (scope) WHERE k < 20"""
    ),
)
def d_warnings(spark, sf):
    """Windows, fields and groups that were too small, by name."""
    detectors = [lambda d: G.numeric_range(d, ["bytes"], W), lambda d: G.drift(d, ["bytes"], ["action"], W), lambda d: G.charset(d, ["session"], W, "display_name")]
    return _every(spark, sf, detectors, lambda o: o.warnings)
