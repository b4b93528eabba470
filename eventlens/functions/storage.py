"""Tables in the folder that all executors share, and joins whose small side is counted first."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A side with at most this many narrow rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. A local one is made only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # the executors of local-cluster are processes of their own
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The folder of the innermost open scope of temporary tables.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """A scope whose intermediate tables are deleted at its end, errors included: results are read from them lazily, so write the results inside.

    Tables made outside any scope stay until the shared folder is cleared. Scopes may be nested; each deletes its own tables.
    """
    folder = new_folder(spark, "scope")
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, whatever executors are lost. See temporary_tables for its end."""
    scope = _scope.get()
    path = f"{scope}/{name}-{uuid.uuid4().hex}" if scope else new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(df: DataFrame, other: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality of columns of two tables."""
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & df[a].eqNullSafe(other[b])
    return out


def observed(metrics: Observation, scan: Callable[[], DataFrame]) -> dict[str, int]:
    """What an observation has counted; by a scan of its own where adaptive execution has found the result empty and dropped the observed part of the plan."""
    try:
        return metrics.get
    except Py4JJavaError:
        return scan().first().asDict()


def running_sums(df: DataFrame, by: list[str], block: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: its sum over the rows before in the order of a group, 0 for the first.

    A group (by) is cut into blocks that follow one another in the order; only blocks are sorted in one task, and
    the blocks' totals, a row a block, are added up.
    """
    df = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    totals = df.groupBy(*by, block).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, block, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    out = own.join(totals, [*by, block])
    return out.withColumns({n: F.col(f"_b_{n}") + F.col(f"_i_{n}") for n in sums}).drop(*[f"_{k}_{n}" for k in "vbi" for n in sums])


def carried_last(df: DataFrame, by: list[str], block: str, order: list[str], values: dict[str, Column], before: bool = False, backwards: bool = False) -> DataFrame:
    """df with a column for each of values: its last non-null value up to the row (or before it), in the order of a group; blocks as in running_sums.

    backwards: the group is gone through from its end, so the values come from the rows after.
    """
    turned = (lambda c: F.desc(c)) if backwards else (lambda c: F.asc(c))
    df = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    at = F.struct(*order)
    pick = F.min_by if backwards else F.max_by
    ends = df.groupBy(*by, block).agg(*[pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in values])
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy(turned(block)).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, block, *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy(*by, block).orderBy(*map(turned, order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = df.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    out = own.join(ends, [*by, block])
    return out.withColumns({n: F.coalesce(f"_i_{n}", f"_b_{n}") for n in values}).drop(*[f"_{k}_{n}" for k in "vbi" for n in values])


#: Rows of a stretch that one task sorts, about.
STRETCH = 1_000_000


def stretches(df: DataFrame, by: list[str], block: str, cell: Column, most: int | None = None) -> DataFrame:
    """df with its blocks cut where they hold too many rows: block becomes (block, part), in the same order.

    Blocks are counted first. Those of more than `most` rows are cut between cells, finer pieces of the same order, so that each part holds
    about `most` rows, or one cell.
    """
    most = most or STRETCH
    counts = materialize(df.groupBy(*by, block).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most), "hot-blocks")
    if counts.isEmpty():
        return df.withColumn(block, F.struct(F.col(block).alias("block"), F.lit(0).cast("long").alias("part")))
    df = df.withColumn("_cell", cell)
    hot = small(counts.select(*[F.col(c).alias(f"_h_{c}") for c in (*by, block)]))
    same = F.lit(True)
    for c in (*by, block):
        same = same & df[c].eqNullSafe(F.col(f"_h_{c}"))
    cells = df.join(hot, same, "left_semi").groupBy(*by, block, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by, block).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / most)
    cells = materialize(cells.withColumn("_part", part).drop("_n"), "cells")  # cells of hot blocks only
    keys = [*by, block, "_cell"]
    cells = small(cells.select("_part", *[F.col(c).alias(f"_c_{c}") for c in keys]))
    same = F.lit(True)
    for c in keys:
        same = same & df[c].eqNullSafe(F.col(f"_c_{c}"))
    out = df.join(cells, same, "left").drop(*[f"_c_{c}" for c in keys], "_cell")
    return out.withColumn(block, F.struct(F.col(block).alias("block"), F.coalesce("_part", F.lit(0)).alias("part"))).drop("_part")


def with_rows_before(df: DataFrame, by: list[str], block: str, order: list[str], n: int) -> DataFrame:
    """df with `_carried`: false for its own rows, true for copies of the n rows before each block, so a window over (by, block) sees across its border.

    Only the last n rows of each block, few for each group, are sorted in one task.
    """
    plain = [c for c in df.columns if c not in by and c != block]
    down = Window.partitionBy(*by, block).orderBy(*[F.desc_nulls_last(c) for c in order])
    tails = df.withColumn("_back", F.row_number().over(down)).where(F.col("_back") <= n)
    up = Window.partitionBy(*by).orderBy(block, *order)
    tails = tails.withColumn("_before", F.collect_list(F.struct(*plain)).over(up.rowsBetween(-n, -1)))
    first = F.row_number().over(Window.partitionBy(*by, block).orderBy(F.desc("_back")))
    heads = tails.withColumn("_first", first).where("_first = 1").select(*by, block, F.explode("_before").alias("_x"))
    carried = heads.select(*by, block, "_x.*", F.lit(True).alias("_carried"))
    return df.withColumn("_carried", F.lit(False)).unionByName(carried)
