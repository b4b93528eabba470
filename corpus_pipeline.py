"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. The first four return the columns of documents:

1. language ID: documents without a letter, and those whose best language has a mean probability of hardly more
   than chance (see least_score), go; the network learns from the given documents' own labels.
2. near-duplicates: of each group of linked documents the one of smallest doc_id stays (once, if its row is
   repeated; with each of its texts, if that doc_id has several).
3. decontamination: documents with any run of a benchmark item go.
4. mixing: all stay, in the order of the mixture; part files follow one another, and so do rows in them.
5. packing: that order decides which documents are packed together: consecutive ones form a shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.llm import decontam, langid, mixing, neardup, packing
from eventlens.llm.common import free, materialize, shared_dir, small, table

#: A document has a language if its best one's mean probability exceeds chance by this share of what is left to 1.
LEAST_GAIN = 2 / 15
#: Consecutive documents that are packed together.
SHARD_DOCS = 256


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone: few ids, counted before they are broadcast; texts are shuffled only if they are many."""
    gone = small(materialize(gone.where("doc_id IS NOT NULL").select("doc_id").distinct(), "pipeline-gone"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def least_score(languages: int) -> float:
    """The lowest score that counts as a language, for so many of them: 0.35 for four."""
    return 1 / languages + LEAST_GAIN * (1 - 1 / languages)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.fit(docs)
    found = langid.identify(docs, net)
    bound = least_score(len(net.langs)) if net else 0.0
    return _without(docs.where(F.col("text").rlike(r"\p{L}")), found.where((F.col("lang_pred") != "und") & (F.col("score") < bound)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialize(neardup.near_duplicates(docs, 85), "pipeline-groups")
    again = found.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1")
    out = _without(docs, found.where("NOT kept"))
    return out if again.isEmpty() else out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(out.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated")
    gone = materialize(found.where("contaminated"), "pipeline-contaminated")
    out = _without(docs, gone)
    # Rows without an id cannot be told apart by it: they are judged again, by themselves.
    if gone.where("doc_id IS NULL").isEmpty():
        return out
    alone = out.where("doc_id IS NULL").withColumn("doc_id", F.xxhash64("text"))
    dirty = decontam.decontaminate(alone, table(spark, sf_dir, "benchmark")).where("contaminated")
    kept = _without(alone, dirty).withColumn("doc_id", F.lit(None).cast("long"))
    return out.where("doc_id IS NOT NULL").unionByName(kept.select(*docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_in_order(docs)


def _position(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs read from files, with each row's position in the order of file names and rows; columns of any names may be there."""
    file, row, n, earlier = free(docs, "_file", "_row", "_n", "_before")
    rows = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    files = materialize(rows.groupBy(file).agg(F.count(F.lit(1)).alias(n)), "pipeline-files")
    before = F.coalesce(F.sum(n).over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = small(files.select(file, before.alias(earlier)))  # a row a file
    return rows.join(files, file), F.col(earlier) + F.col(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, position = _position(docs)
    shard = F.lpad(F.floor(position / SHARD_DOCS).cast("string"), 9, "0")
    return packing.packed_rows(rows, shard=shard, place=position)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs, top = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
    return docs


#: Language ID, registers and packing have no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None
