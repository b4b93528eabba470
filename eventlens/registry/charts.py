"""Charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import charts as C
from ..plans import filters as P
from . import query

S = "CAST(floor(ms / 1000) AS BIGINT)"


def _where(cond: str) -> str:
    return f"SELECT {S} AS s FROM ev WHERE ms IS NOT NULL AND {cond}"


def _hist(rows: str, buckets: int) -> str:
    return f", r AS ({rows}), sp AS (SELECT min(s) AS lo, max(s) AS hi, greatest(1, CAST(floor((max(s) - min(s)) / {buckets}) AS BIGINT)) AS step FROM r)"


@query("hist_time", X.sql(_hist(_where("artifact = 'error'"), 60) + " SELECT CAST(floor(s / step) AS BIGINT) * step AS bucket, count(*) AS n FROM r, sp GROUP BY 1"))
def hist_time(spark, sf):
    """Events of type error over time."""
    return C.hist_time(P.where(X.events(spark, sf), P.EventQuery(artifact="error")))


GRID = ", g AS (SELECT unnest(range(CAST(floor(lo / step) AS BIGINT) * step, hi + 1, step)) AS bucket, step FROM sp)"


@query("bucket_grid", X.sql(_hist(_where("list_contains(tags, 'high')"), 200) + GRID + ", c AS (SELECT CAST(floor(s / step) AS BIGINT) * step AS bucket, count(*) AS n FROM r, sp GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (bucket)"))
def bucket_grid(spark, sf):
    return C.bucket_grid(P.where(X.events(spark, sf), P.EventQuery(tag="high")), 200)


def _summary(by: str = "") -> str:
    qs = ", ".join(f"round(quantile_cont(x, {p}), 6) AS q{int(p * 100):02d}" for p in C.QUANTILES)
    skew = "round(CASE WHEN var_pop(x) > 0 THEN avg((x - mu) ** 3) / pow(var_pop(x), 1.5) END, 6)"
    return f"{by}count(*) AS n, min(x) AS lo, max(x) AS hi, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, {skew} AS skew, {qs}"


@query("numeric_stats", X.sql(f", x AS (SELECT CAST(a_bytes AS DOUBLE) AS x, avg(CAST(a_bytes AS DOUBLE)) OVER () AS mu FROM ev) SELECT {_summary()} FROM x"))
def numeric_stats(spark, sf):
    return C.numeric_stats(X.events(spark, sf), "bytes")


BINS = "least(greatest(CAST(ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1.0 / 3))) AS INT), 5), 60)"


@query(
    "numeric_bins",
    X.sql(
        f", x AS (SELECT CAST(a_bytes AS DOUBLE) AS x FROM ev), e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3 FROM x), f AS (SELECT lo, hi, {BINS} AS bins FROM e) SELECT CAST(least(greatest(floor((x - lo) / (hi - lo) * bins), 0), bins - 1) AS INT) AS bin, count(*) AS n, bins, 'freedman-diaconis' AS rule FROM x, f GROUP BY 1, 3"
    ),
)
def numeric_bins(spark, sf):
    return C.numeric_bins(X.events(spark, sf), "bytes")


@query(
    "numeric_grouped",
    X.sql(
        f", x AS (SELECT display_name AS g, CAST(a_bytes AS DOUBLE) AS x, avg(CAST(a_bytes AS DOUBLE)) OVER (PARTITION BY display_name) AS mu FROM ev), z AS (SELECT g, count(*) AS size FROM x GROUP BY g), t AS (SELECT g FROM z ORDER BY size DESC, g LIMIT 10) SELECT {_summary('g, ')}, (SELECT greatest(count(*) - 10, 0) FROM z) AS omitted FROM x JOIN t USING (g) GROUP BY g"
    ),
)
def numeric_grouped(spark, sf):
    return C.numeric_grouped(X.events(spark, sf), "bytes", "display_name", 10)


@query(
    "value_timeseries",
    X.sql(
        f", t AS (SELECT display_name AS value FROM ev GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"
        + _hist(_where("true"), 30)
        + GRID
        + f", c AS (SELECT display_name AS value, CAST(floor({S} / step) AS BIGINT) * step AS bucket, count(*) AS n FROM ev, sp WHERE ms IS NOT NULL GROUP BY 1, 2) SELECT value, bucket, coalesce(n, 0) AS n FROM t CROSS JOIN g LEFT JOIN c USING (value, bucket)"
    ),
)
def value_timeseries(spark, sf):
    return C.value_timeseries(X.events(spark, sf), "display_name", 5, 30)


def _layers(spark, sf):
    ev = X.events(spark, sf)
    return P.where(ev, P.EventQuery(artifact="error")), P.where(ev, P.EventQuery(tag="tens"))


LAYERS = ", two AS (SELECT *, 1 AS a FROM ev WHERE artifact = 'error' UNION ALL SELECT *, 0 AS a FROM ev WHERE list_contains(tags, 'tens'))"


@query("compare_time", X.sql(LAYERS + _hist(f"SELECT {S} AS s, a FROM two WHERE ms IS NOT NULL", 60) + GRID + ", c AS (SELECT CAST(floor(s / step) AS BIGINT) * step AS bucket, sum(a) AS n_a, sum(1 - a) AS n_b FROM r, sp GROUP BY 1) SELECT bucket, CAST(coalesce(n_a, 0) AS BIGINT) AS n_a, CAST(coalesce(n_b, 0) AS BIGINT) AS n_b FROM g LEFT JOIN c USING (bucket)"))
def compare_time(spark, sf):
    return C.compare_time(*_layers(spark, sf))


@query("compare_terms", X.sql(LAYERS + ", t AS (SELECT a_ua AS value FROM two WHERE a = 1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT coalesce(t.value, '') AS value, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(1 - a) AS BIGINT) AS n_b FROM two LEFT JOIN t ON a_ua = t.value GROUP BY 1"))
def compare_terms(spark, sf):
    return C.compare_terms(*_layers(spark, sf), "ua", 10)


@query("compare_numeric", X.sql(LAYERS + ", e AS (SELECT min(CAST(a_bytes AS DOUBLE)) AS lo, max(CAST(a_bytes AS DOUBLE)) AS hi FROM two) SELECT CAST(least(floor((CAST(a_bytes AS DOUBLE) - lo) / (hi - lo) * 20), 19) AS INT) AS bin, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(1 - a) AS BIGINT) AS n_b FROM two, e GROUP BY 1"))
def compare_numeric(spark, sf):
    return C.compare_numeric(*_layers(spark, sf), "bytes", 20)


@query("punchcard", X.sql("SELECT CAST(isodow(ts) AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM ev WHERE ts IS NOT NULL GROUP BY 1, 2"))
def punchcard(spark, sf):
    return C.punchcard(X.events(spark, sf))


@query("pivot", X.sql(", t AS (SELECT display_name AS v FROM ev WHERE ts IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) SELECT coalesce(t.v, '') AS x, strftime(ts, '%H') AS y, count(*) AS n FROM ev LEFT JOIN t ON display_name = t.v WHERE ts IS NOT NULL GROUP BY 1, 2"))
def pivot(spark, sf):
    return C.pivot(X.events(spark, sf), "display_name", "time:hour_of_day", 8)


PAIRS = """, v AS (SELECT CAST(a_bytes AS DOUBLE) AS bytes, CAST(a_k AS DOUBLE) AS k, CAST(a_user AS DOUBLE) AS usr FROM ev),
 p AS (SELECT 'bytes' AS fx, 'k' AS fy, bytes AS x, k AS y FROM v UNION ALL SELECT 'bytes', 'user', bytes, usr FROM v UNION ALL SELECT 'k', 'user', k, usr FROM v),
 q AS (SELECT *, rank() OVER (PARTITION BY fx, fy ORDER BY x) + (count(*) OVER (PARTITION BY fx, fy, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY fx, fy ORDER BY y) + (count(*) OVER (PARTITION BY fx, fy, y) - 1) / 2.0 AS ry FROM p)"""


@query("correlation", X.sql(f"{PAIRS} SELECT fx, fy, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM q GROUP BY fx, fy"))
def correlation(spark, sf):
    """Without p, which SQL cannot express; tests hold it against constants."""
    return C.correlation(X.events(spark, sf), ["bytes", "k", "user"]).drop("p")


@query(
    "scatter",
    X.sql(f"{PAIRS} SELECT count(*) AS n, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM q WHERE fx = 'bytes' AND fy = 'k'"),
)
def scatter(spark, sf):
    return C.scatter(X.events(spark, sf), "bytes", "k")


@query("sample_stable", X.sql("SELECT event_id FROM ev ORDER BY md5(event_id), event_id LIMIT 200"))
def sample_stable(spark, sf):
    """A sampling operator: the limit is the feature."""
    return C.stable_sample(X.events(spark, sf).select("event_id"), 200)


@query(
    "kendall",
    X.sql(
        ", s AS (SELECT event_id, CAST(a_bytes AS DOUBLE) AS x, CAST(a_k AS DOUBLE) AS y FROM ev ORDER BY md5(event_id), event_id LIMIT 500), p AS (SELECT sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM s a JOIN s b ON a.event_id < b.event_id) SELECT (SELECT count(*) FROM s) AS n, round(sum(dx * dy) / sqrt(sum(dx * dx) * CAST(sum(dy * dy) AS DOUBLE)), 6) AS tau FROM p"
    ),
)
def kendall(spark, sf):
    return C.kendall_sample(X.events(spark, sf), "bytes", "k", 500).drop("p")


@query("kendall_full")
def kendall_full(spark, sf):
    """At the reference's 5,000 points. No SQL, which would join all pairs: a test compares it with brute force."""
    return C.kendall_sample(X.events(spark, sf), "bytes", "k", 5000).drop("p")


@query("normality")
def normality(spark, sf):
    """No SQL: tests hold Shapiro and Wilk's W and p against constants."""
    return C.normality(X.events(spark, sf), ["bytes", "k"])


@query("lineitem_correlation", "SELECT 'l_quantity' AS fx, 'l_extendedprice' AS fy, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def lineitem_correlation(spark, sf):
    """Plain numeric columns read as attributes."""
    rows = X.read(spark, sf, "lineitem").select(F.create_map(F.lit("l_quantity"), F.col("l_quantity").cast("string"), F.lit("l_extendedprice"), F.col("l_extendedprice").cast("string")).alias("attributes"))
    return C.correlation(rows, ["l_quantity", "l_extendedprice"]).select("fx", "fy", "n", "pearson")
