"""What the corpus operators share: reading tables, shared storage, safe broadcasts, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize, shared_dir  # noqa: F401 (for the operators and the pipeline)

#: A side with at most this many narrow rows (ids, hashes) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
#: Characters of texts that a task cuts into words at once.
PORTION = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts can be long: Arrow batches of 10,000 rows (the default) would be large in the JVM and in Python workers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def held_batches(pdf: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows of pdf whose texts have about PORTION characters together, one row at least."""
    size = pdf[column].str.len().fillna(0).to_numpy(np.int64)
    lo = held = 0
    for i, n in enumerate(size.tolist()):
        held += n
        if held >= PORTION or i == len(size) - 1:
            yield pdf.iloc[lo : i + 1]
            lo, held = i + 1, 0


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id's text leaves remainder 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with more underscores where df has such columns."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b): (node, component), component the smallest node.

    Every round takes the smallest label among neighbours and then follows labels once more, so stars
    end in two rounds and chains in logarithmically many. A hub's edges are pre-aggregated before each
    shuffle; the joins are plain equi-joins whose skewed partitions Spark can split.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = materialize(both.where("node <> other").distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other")
        near = near.groupBy("node").agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels_new = materialize(lower.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")), f"{name}-{step}")
        if labels_new.where("was <> label").isEmpty():
            return labels_new.select("node", F.col("label").alias("component"))
        labels = labels_new.select("node", "label")
