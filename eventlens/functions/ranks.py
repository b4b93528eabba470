"""Ranks, quantiles and false-discovery rates of values that no task could sort alone.

Values are counted first. The counts of a group are cut into ranges of values at approximate quantiles; ranges are
ordered by themselves, and their totals are added up over the ranges, which are few. Results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, materialize, running_sums, small

#: Ranges of the values of a group.
RANGES = 32


def _ranged(counts: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """counts with `_block`: the number of its group's cuts below x. Cuts are computed once, as two passes could differ."""
    cuts = F.percentile_approx(x, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(1000)).alias("_cuts")
    made = materialize(counts.groupBy(*by).agg(cuts), "ranks-cuts")
    rows = counts.join(small(made), list(by)) if by else counts.crossJoin(F.broadcast(made))  # one row
    return rows.withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")


def cumulative(counts: DataFrame, by: Sequence[str], x: str, weights: Sequence[str]) -> DataFrame:
    """counts (a row for each value x of a group) with before_<w>, the sum of w over smaller values, and total_<w>."""
    by, counts = list(by), materialize(counts, "ranks-counts")
    if counts.count() <= BROADCAST_ROWS:  # as few as may be broadcast are as few as a task may sort
        group = Window.partitionBy(*by or [F.lit(0)])
        earlier = group.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumns({f"before_{w}": F.coalesce(F.sum(w).over(earlier), F.lit(0)) for w in weights} | {f"total_{w}": F.sum(w).over(group) for w in weights})
    out = running_sums(_ranged(counts, by, x), by, "_block", [x], {f"before_{w}": F.col(w) for w in weights}).drop("_block")
    totals = counts.groupBy(*by).agg(*[F.sum(w).alias(f"total_{w}") for w in weights])
    return out.join(small(totals), by) if by else out.crossJoin(F.broadcast(totals))  # one row


def quantiles(df: DataFrame, by: Sequence[str], x: str, shares: Sequence[float]) -> DataFrame:
    """(by..., q): the values of x at the given shares of its rows, between two neighbours in proportion."""
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n")).where(F.col(x).isNotNull())
    rows = cumulative(counts, by, x, ["_n"])
    last = F.col("total__n") - 1

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before__n") <= place) & (place < F.col("before__n") + F.col("_n")), F.col(x)))

    places = [(F.lit(p) * last) for p in shares]
    found = rows.groupBy(*by).agg(F.first("total__n").alias("_m"), *[at(F.floor(p)).alias(f"_lo{i}") for i, p in enumerate(places)], *[at(F.ceil(p)).alias(f"_hi{i}") for i, p in enumerate(places)])
    part = lambda i, p: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p * (F.col("_m") - 1) - F.floor(F.lit(p) * (F.col("_m") - 1)))
    return found.select(*by, F.array(*[part(i, p) for i, p in enumerate(shares)]).alias("q"))


def q_values(df: DataFrame, p: str, q: str, pool: Sequence[str] = ()) -> DataFrame:
    """df with Benjamini and Hochberg's q of its p values over one pool or each pool; null where p is null.

    Equal p have equal q, so the work is on distinct p: each times the pool's size over its highest rank, and the
    smallest of that over it and all larger p.
    """
    pool, df = list(pool), materialize(df, "fdr-tests")
    if df.count() <= BROADCAST_ROWS:  # as in cumulative
        group = Window.partitionBy(F.col(p).isNull(), *pool)
        own = F.col(p) * F.count(p).over(group) / F.count(p).over(group.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        rows = df.withColumn("_own", own)
        low = F.min("_own").over(group.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), low))).drop("_own")
    counts = df.where(F.col(p).isNotNull()).groupBy(*pool, p).agg(F.count(F.lit(1)).alias("_n"))
    rows = _ranged(cumulative(counts, pool, p, ["_n"]), pool, p)
    rows = materialize(rows.select(*pool, p, "_block", (F.col(p) * F.col("total__n") / (F.col("before__n") + F.col("_n"))).alias("_own")), "fdr-ranks")
    blocks = rows.groupBy(*pool, "_block").agg(F.min("_own").alias("_low"))
    after = Window.partitionBy(*pool or [F.lit(0)]).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*pool, "_block", F.min("_low").over(after).alias("_later"))  # RANGES rows a pool
    # From the largest p down: a frame that ends at the block's end would be gone through anew for each row.
    inside = F.min("_own").over(Window.partitionBy(*pool, "_block").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    done = rows.withColumn("_low", inside).join(small(blocks), [*pool, "_block"]).select(*pool, p, F.least(F.lit(1.0), "_low", "_later").alias(q))
    return df.join(small(done), [*pool, p], "left")
