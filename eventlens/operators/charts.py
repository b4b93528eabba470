"""Aggregates for charts: histograms, distributions, correlations, pivots, layer comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import TIME_DOMAINS, effective_time, number, resolve
from ..functions.ranks import cumulative, quantiles
from ..functions.storage import materialize, small
from ..functions.stats import kendall, r_p_column, shapiro_wilk
from .explore import terms

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def one_row(df: DataFrame) -> DataFrame:
    """A global aggregate, for joining to every row."""
    return F.broadcast(df)


def seconds(offsets: Mapping[str, float] | None = None) -> Column:
    return F.floor(F.unix_millis(effective_time(offsets)) / 1000)


def _span(df: DataFrame, buckets: int) -> DataFrame:
    """(lo, hi, step): dated range in whole seconds and the bucket length, at least one second."""
    s = df.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return s.withColumn("step", F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / buckets)).cast("long"))


def hist_time(df: DataFrame, buckets: int = 60, offsets: Mapping[str, float] | None = None) -> DataFrame:
    """(bucket, n): events by epoch-aligned buckets over the dated range; bucket in epoch seconds."""
    rows = df.select(seconds(offsets).alias("s")).where("s IS NOT NULL")
    out = rows.crossJoin(one_row(_span(rows, buckets))).groupBy((F.floor(F.col("s") / F.col("step")) * F.col("step")).alias("bucket"))
    return out.agg(F.count(F.lit(1)).alias("n"))


def grid(span: DataFrame) -> DataFrame:
    """All aligned bucket starts of a span (lo, hi, step), the partial last one included."""
    start = F.floor(F.col("lo") / F.col("step")) * F.col("step")
    return span.where("lo IS NOT NULL").select(F.explode(F.sequence(start, F.floor(F.col("hi") / F.col("step")) * F.col("step"), F.col("step"))).alias("bucket"), "step")


def bucket_grid(df: DataFrame, buckets: int = 60) -> DataFrame:
    """(bucket, n) with zeros filled in."""
    rows = df.select(seconds().alias("s")).where("s IS NOT NULL")
    return grid(_span(rows, buckets)).select("bucket").join(hist_time(df, buckets), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def _numbers(df: DataFrame, field: str, mappings=None) -> DataFrame:
    return df.select(number(resolve(field, mappings)).alias("x")).where("x IS NOT NULL")


def numeric_summary(x: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, extremes, mean, population deviation and skewness, and QUANTILES of x."""
    x = materialize(x.select(*by, "x"), "numbers")  # read twice
    out = x.groupBy(*by).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.skewness("x").alias("skew"))
    q = quantiles(x, by, "x", QUANTILES)
    out = out.join(small(q), list(by), "left") if by else out.crossJoin(one_row(q))
    return out.select(*by, "n", "lo", "hi", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "skew")], *[F.round(F.get("q", i), 6).alias(f"q{int(p * 100):02d}") for i, p in enumerate(QUANTILES)])


def bin_rule(summary: DataFrame) -> DataFrame:
    """(lo, hi, bins, rule): bins by Freedman and Diaconis, clamped to 5..60, or 30."""
    width = 2 * (F.col("q75") - F.col("q25")) / F.pow(F.col("n").cast("double"), 1 / 3)
    usable = (width > 0) & (F.col("hi") > F.col("lo"))
    bins = F.when(usable, F.least(F.greatest(F.ceil((F.col("hi") - F.col("lo")) / width), F.lit(5)), F.lit(60))).otherwise(30)
    return summary.select("lo", "hi", bins.cast("int").alias("bins"), F.when(usable, "freedman-diaconis").otherwise("fallback").alias("rule"))


def binned(x: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n) over equal bins of lo..hi; the last bin holds hi."""
    width = F.col("hi") - F.col("lo")
    i = F.when(width > 0, F.least(F.greatest(F.floor((F.col("x") - F.col("lo")) / width * F.col("bins")), F.lit(0)), F.col("bins") - 1)).otherwise(0)
    return x.crossJoin(one_row(edges)).groupBy(*by, i.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def numeric_stats(df: DataFrame, field: str, mappings=None) -> DataFrame:
    return numeric_summary(_numbers(df, field, mappings))


def numeric_bins(df: DataFrame, field: str, mappings=None) -> DataFrame:
    x = _numbers(df, field, mappings)
    edges = bin_rule(numeric_summary(x))
    return binned(x, edges).crossJoin(one_row(edges.select("bins", "rule")))


def numeric_grouped(df: DataFrame, field: str, group: str, groups: int = 10) -> DataFrame:
    """Summaries of x in the most frequent groups; a blank group is left out, the rest of the groups are counted."""
    x = df.select(resolve(group).alias("g"), number(resolve(field)).alias("x")).where("x IS NOT NULL AND g <> ''")
    x = materialize(x, "grouped-numbers")
    sizes = x.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.desc("size"), "g").limit(groups)
    rest = sizes.agg((F.count(F.lit(1)) - F.lit(groups)).alias("omitted")).select(F.greatest("omitted", F.lit(0)).cast("long").alias("omitted"))
    return numeric_summary(x.join(F.broadcast(top.select("g")), "g"), ["g"]).crossJoin(one_row(rest))


def value_timeseries(df: DataFrame, field: str, top: int = 5, buckets: int = 30) -> DataFrame:
    """(value, bucket, n): the most frequent values (undated rows count for the rank) over a zero-filled grid."""
    rows = df.select(resolve(field).alias("value"), seconds().alias("s")).where("value <> ''")
    best = F.broadcast(terms(df, field, top).select("value"))
    dated = rows.where("s IS NOT NULL")
    span = _span(dated, buckets)
    counts = dated.join(best, "value").crossJoin(one_row(span)).groupBy("value", (F.floor(F.col("s") / F.col("step")) * F.col("step")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = grid(span).select("bucket").crossJoin(best)  # buckets x top values
    return every.join(counts, ["value", "bucket"], "left").select("value", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def compare_time(a: DataFrame, b: DataFrame, buckets: int = 60) -> DataFrame:
    """(bucket, n_a, n_b) of two filters on one grid over both ranges."""
    both = a.select(seconds().alias("s"), F.lit(1).alias("a")).unionByName(b.select(seconds().alias("s"), F.lit(0).alias("a"))).where("s IS NOT NULL")
    span = _span(both, buckets)
    counts = both.crossJoin(one_row(span)).groupBy((F.floor(F.col("s") / F.col("step")) * F.col("step")).alias("bucket")).agg(F.sum("a").alias("n_a"), F.sum(1 - F.col("a")).alias("n_b"))
    return grid(span).select("bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def compare_terms(a: DataFrame, b: DataFrame, field: str, limit: int = 10) -> DataFrame:
    """The first layer's top values fix the categories; all else is folded to ''."""
    best = F.broadcast(terms(a, field, limit).select("value", F.lit(True).alias("top")))
    rows = a.select(resolve(field).alias("value"), F.lit(1).alias("a")).unionByName(b.select(resolve(field).alias("value"), F.lit(0).alias("a"))).where("value <> ''")
    folded = rows.join(best, "value", "left").withColumn("value", F.when(F.col("top"), F.col("value")).otherwise(""))
    return folded.groupBy("value").agg(F.sum("a").alias("n_a"), F.sum(1 - F.col("a")).alias("n_b"))


def compare_numeric(a: DataFrame, b: DataFrame, field: str, bins: int = 20) -> DataFrame:
    """(bin, n_a, n_b) with bin edges from the range of both."""
    x = _numbers(a, field).withColumn("a", F.lit(1)).unionByName(_numbers(b, field).withColumn("a", F.lit(0)))
    edges = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("bins", F.lit(bins))
    return binned(x, edges, ["a"]).groupBy("bin").agg(F.sum(F.when(F.col("a") == 1, F.col("n")).otherwise(0)).alias("n_a"), F.sum(F.when(F.col("a") == 0, F.col("n")).otherwise(0)).alias("n_b"))


def punchcard(df: DataFrame, offsets: Mapping[str, float] | None = None) -> DataFrame:
    ts = effective_time(offsets)
    return df.where(ts.isNotNull()).groupBy((F.weekday(ts) + 1).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def pivot(df: DataFrame, x: str, y: str, limit: int = 10) -> DataFrame:
    """(x, y, n) of rows with both fields; values beyond each axis's top are folded to ''. Bounded time axes keep all."""
    rows = df.select(resolve(x).alias("x"), resolve(y).alias("y")).where("x <> '' AND y <> ''")
    for axis, field in (("x", x), ("y", y)):
        if field in TIME_DOMAINS:
            continue
        best = F.broadcast(rows.groupBy(axis).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), axis).limit(limit).select(axis, F.lit(True).alias("top")))
        rows = rows.join(best, axis, "left").withColumn(axis, F.when(F.col("top"), F.col(axis)).otherwise("")).drop("top")
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, value: str, rank: str, by: Sequence[str]) -> DataFrame:
    """Adds the mean rank of ties."""
    return all_ranks(df, {value: rank}, by)


def all_ranks(df: DataFrame, ranks: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """Adds for each value column of ranks the mean rank of ties. Ranks come from counts of distinct values; df is written once."""
    df = out = materialize(df, "ranked")
    for value, rank in ranks.items():
        counts = cumulative(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), by, value, ["n"])
        out = out.join(small(counts.select(*by, value, (F.col("before_n") + (F.col("n") + 1) / 2).alias(rank))), [*by, value])
    return out


def _pairs(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(fx, fy, x, y): every pair of fields where both are numbers."""
    wide = df.select(*[number(resolve(f)).alias(f"v{i}") for i, f in enumerate(fields)])
    each = [F.struct(F.lit(fields[i]).alias("fx"), F.lit(fields[j]).alias("fy"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y")) for i, j in combinations(range(len(fields)), 2)]
    return wide.select(F.explode(F.array(*each)).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")


def correlation(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(fx, fy, n, pearson, spearman, p): pairwise-complete correlations of 2 to 8 fields; constant axes give null."""
    if not 2 <= len(fields) <= 8:
        raise ValueError("2 to 8 fields")
    rows = all_ranks(_pairs(df, fields), {"x": "rx", "y": "ry"}, ["fx", "fy"])
    out = rows.groupBy("fx", "fy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"), ((F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))).alias("flat")
    )
    out = out.withColumns({c: F.when(~F.col("flat"), F.col(c)) for c in ("pearson", "spearman")}).drop("flat")
    return out.withColumn("p", r_p_column(F.col("pearson"), F.col("n")))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: extents, correlations and the least-squares line of all pairs."""
    rows = all_ranks(_pairs(df, [x, y]), {"x": "rx", "y": "ry"}, ["fx", "fy"])
    r = lambda c, name: F.round(c, 6).alias(name)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"),
        r(F.corr("x", "y"), "pearson"), r(F.corr("rx", "ry"), "spearman"), r(F.regr_slope("y", "x"), "slope"), r(F.regr_intercept("y", "x"), "intercept"), r(F.regr_r2("y", "x"), "r2"),
    )


def stable_sample(df: DataFrame, n: int) -> DataFrame:
    """The n rows whose ids have the smallest hash: the same on every run."""
    return df.orderBy(F.md5("event_id"), "event_id").limit(n)


def sample_points(df: DataFrame, x: str, y: str, n: int = 5000) -> DataFrame:
    rows = df.select("event_id", number(resolve(x)).alias("x"), number(resolve(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return stable_sample(rows, n)


def kendall_sample(df: DataFrame, x: str, y: str, n: int = 2000) -> DataFrame:
    """(n, tau, p) of a stable sample, in one task: the sample is bounded by n."""

    def run(batches):
        pdf = pd.concat(list(batches) or [pd.DataFrame({"x": [], "y": []})])
        found = kendall(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        yield pd.DataFrame({"n": [len(pdf)], "tau": [round(found[0], 6) if found else None], "p": [found[1] if found else None]}).astype({"tau": "float64", "p": "float64"})

    return sample_points(df, x, y, n).select("x", "y").coalesce(1).mapInPandas(run, "n long, tau double, p double")


def normality(df: DataFrame, fields: Sequence[str], n: int = 1000) -> DataFrame:
    """(field, n, w, p, normal) of Shapiro and Wilk on a bounded stable sample of each field; normal: p > 0.05."""
    rows = stable_sample(df.select("event_id", *[number(resolve(f)).alias(f"v{i}") for i, f in enumerate(fields)]), n)
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v{i}").alias("x")) for i, f in enumerate(fields)])).alias("p")).select("p.*").where("x IS NOT NULL")

    def run(key, pdf):
        found = shapiro_wilk(pdf["x"].to_numpy())
        return pd.DataFrame({"field": [key[0]], "n": [len(pdf)], "w": [found[0] if found else np.nan], "p": [found[1] if found else np.nan], "normal": [bool(found and found[1] > 0.05)]})

    return each.groupBy("field").applyInPandas(run, "field string, n long, w double, p double, normal boolean")
