"""Statistics of fields that are kept as a table, a row a source and field, and merged without the events.

Values: coverage, a sketch of the distinct values, a few samples and the most frequent values. Lists are cut, so a merged
count has a lower and an upper bound; they meet where no list was cut. Numbers: extremes, sums and a sketch of
quantiles. Sketches of sources merge to those of all their rows, so any choice of sources is summed up from the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import number
from ..functions.storage import materialize
from .explore import LONGEST_VALUE, MOST_VALUES, pairs

SAMPLES = 3
#: Sketch sizes: distinct counts are within about 0.8 %, quantiles within about 0.5 % of the ranks.
HLL_BITS, KLL_SIZE = 14, 800


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(source_id, key, val): non-blank attributes, and those top-level columns that are asked for."""
    out = pairs(df).select("source_id", "key", "val")
    for c in columns:
        out = out.unionByName(df.where(F.col(c) != "").select("source_id", F.lit(c).alias("key"), F.col(c).alias("val")))
    return out


def value_summaries(df: DataFrame, columns: Sequence[str] = (), most: int = MOST_VALUES) -> DataFrame:
    """(source_id, key, coverage, n_distinct, longest, sketch, samples, top, floor) of each source's fields.

    top: the `most` most frequent values with their counts; null where one of them is longer than LONGEST_VALUE. floor: no value that top
    leaves out occurs more often; 0 where it leaves out none.
    """
    counts = materialize(_cells(df, columns).groupBy("source_id", "key", "val").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    by = ["source_id", "key"]
    keys = counts.groupBy(*by).agg(F.sum("n").alias("coverage"), F.count(F.lit(1)).alias("n_distinct"), F.max(F.length("val")).cast("int").alias("longest"), F.hll_sketch_agg("val", F.lit(HLL_BITS)).alias("sketch"))
    often = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "val"))
    top = counts.withColumn("r", often).where(F.col("r") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "val", "n"))).alias("t"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("val"))
    few = counts.withColumn("r", first).where(F.col("r") <= SAMPLES).groupBy(*by).agg(F.array_sort(F.collect_list("val")).alias("samples"))
    rows = keys.join(top, by).join(few, by)
    listed = F.transform("t", lambda x: F.struct(x["val"].alias("val"), x["n"].alias("n")))
    short = F.forall("t", lambda x: F.length(x["val"]) <= LONGEST_VALUE)
    floor = F.when(F.col("n_distinct") > most, F.element_at("t", -1)["n"]).otherwise(F.lit(0).cast("long"))
    return rows.select(*by, "coverage", "n_distinct", "longest", "sketch", "samples", F.when(short, listed).alias("top"), floor.alias("floor"))


def merged_fields(summaries: DataFrame) -> DataFrame:
    """(key, coverage, n_distinct, longest, n_sources, samples, listed, exact): n_distinct from the merged sketches; listed: merged_values has the field; exact: with equal bounds."""
    out = summaries.groupBy("key").agg(
        F.sum("coverage").alias("coverage"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"), F.max("longest").alias("longest"), F.count(F.lit(1)).alias("n_sources"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("samples")))), 1, SAMPLES).alias("samples"), F.every(F.col("top").isNotNull()).alias("listed"), F.every(F.col("floor") == 0).alias("exact"),
    )
    return out


def merged_values(summaries: DataFrame, limit: int = 10) -> DataFrame:
    """(key, rank, value, n, most, total, other): the `limit` most frequent values over all sources.

    A value occurs n times at least and `most` times at most. Fields with a source that has no list are left out: they
    must be counted on the events.
    """
    whole = summaries.groupBy("key").agg(F.sum("coverage").alias("total"), F.sum("floor").alias("floors"), F.every(F.col("top").isNotNull()).alias("listed")).where("listed")
    each = summaries.select("key", "floor", F.explode("top").alias("t")).select("key", "floor", F.col("t.val").alias("value"), "t.n")
    sums = each.groupBy("key", "value").agg(F.sum("n").alias("n"), F.sum("floor").alias("own"))
    r = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "value"))
    best = sums.withColumn("rank", r).where(F.col("rank") <= limit).join(whole, "key")
    shown = F.sum("n").over(Window.partitionBy("key"))  # `limit` rows a key
    return best.select("key", "rank", "value", "n", (F.col("n") + F.col("floors") - F.col("own")).alias("most"), "total", (F.col("total") - shown).alias("other"))


def number_summaries(df: DataFrame, columns: Sequence[str] = (), size: int = KLL_SIZE) -> DataFrame:
    """(source_id, key, n, lo, hi, total, square, sketch) of the numbers of each source's fields: one scan, partial sketches in every task."""
    x = _cells(df, columns).select("source_id", "key", number(F.col("val")).alias("x")).where("x IS NOT NULL")
    square = F.sum(F.col("x") * F.col("x"))
    return x.groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("total"), square.alias("square"), F.kll_sketch_agg_double("x", F.lit(size)).alias("sketch"))


def merged_numbers(summaries: DataFrame, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), by: Sequence[str] = ("key",)) -> DataFrame:
    """(by..., n, lo, hi, mean, sd, q): any rows of number_summaries put together; q are approximate quantiles at the shares, inside lo..hi."""
    out = summaries.groupBy(*by).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.sum("square").alias("square"), F.kll_merge_agg_double("sketch").alias("sketch"))
    mean = F.col("total") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("square") / F.col("n") - mean * mean, F.lit(0.0)))
    q = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in shares]))
    return out.select(*by, "n", "lo", "hi", F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"), q.alias("q"))
