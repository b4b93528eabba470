"""Reading files: lines with byte offsets, file hashes, time bounds with counters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import clean_attributes, event_id
from ..functions.storage import observed, running_sums

#: What parsers return, before provenance.
PARSED = ("timestamp", "timestamp_desc", "message", "artifact", "artifact_long", "display_name", "tags", "attributes")


def read_lines(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(source_file, raw) of every line of a file, or of all files below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(path)
    return rows.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))


def read_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, byte_offset, line_number, raw) of the lines of a file, or of all files below a folder.

    Offsets are exact bytes in each file, line numbers begin at 1; lines end at line feeds, and a carriage return
    before is dropped from raw. Each file block's lines are added up by themselves, so a large file is no one task's.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    sums = {"byte_offset": F.octet_length("raw").cast("long") + 1, "_before": F.lit(1).cast("long")}
    out = running_sums(rows, ["source_file"], "_block", ["_at"], sums)
    return out.select("source_file", "byte_offset", (F.col("_before") + 1).alias("line_number"), F.regexp_replace("raw", "\r$", "").alias("raw"))


def as_one_file(lines: DataFrame) -> DataFrame:
    """(byte_offset, line_number, raw) of lines of part files that end with a line feed, as if these were one file, in the order of their names."""
    sizes = lines.groupBy("source_file").agg(F.max(F.struct("byte_offset", (F.col("byte_offset") + F.octet_length("raw") + 1).alias("end"), "line_number")).alias("last"))  # a row a file
    earlier = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(f"last.{c}").over(earlier), F.lit(0))
    sizes = sizes.select("source_file", before("end").alias("_bytes"), before("line_number").alias("_lines"))
    return lines.join(sizes, "source_file").select((F.col("_bytes") + F.col("byte_offset")).alias("byte_offset"), (F.col("_lines") + F.col("line_number")).alias("line_number"), "raw")


#: Files up to this are hashed as one value; larger ones are read in pieces.
WHOLE, PIECE = 64 << 20, 4 << 20


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of files, read in pieces from their file system: one piece is held at a time."""
    for pdf in batches:
        hashes = []
        for path in pdf["source_file"]:
            system, inside = pyarrow.fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(inside, buffer_size=0) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
            hashes.append(digest.hexdigest())
        if hashes:
            yield pd.DataFrame({"source_file": pdf["source_file"], "file_hash": hashes})


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(source_file, file_hash): SHA-256 of a file, or of all files below a folder, of any size.

    Files of up to `whole` bytes are read by Spark, so they can be in any store. A digest cannot be cut: each larger file is one task's, which
    streams it; its store must be one that Arrow opens (local and shared folders, HDFS, object stores).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    few = files.where(F.col("length") <= whole).select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("file_hash"))
    sizes = files.where(F.col("length") > whole).select(F.col("path").alias("source_file"), "length")
    # Names and sizes only: they are counted, and each large file goes to a task of its own, the largest first.
    large = sizes.count()
    if not large:
        return few
    dealt = sizes.repartitionByRange(large, F.desc("length"), "source_file").select("source_file")
    return few.unionByName(dealt.mapInPandas(_streamed, "source_file string, file_hash string"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (source_file, file_hash) whose hash is not among those known, each hash once."""
    return files.join(known.select("file_hash").distinct(), "file_hash", "left_anti").groupBy("file_hash").agg(F.min("source_file").alias("source_file"))


def stamp(parsed: DataFrame, case_id: str, source_id: str, parser: str, version: str = "1") -> DataFrame:
    """Parsed rows as events with deterministic ids.

    Rows need raw, a content_hash or a byte_offset: without any, all rows of a file would get one id, so they are
    refused. A content_hash that the rows bring is kept.
    """
    if not {"raw", "content_hash", "byte_offset"} & set(parsed.columns):
        raise ValueError("rows without raw text, content_hash or byte_offset cannot be told apart")
    for name, kind in (("raw", "string"), ("file_hash", "string"), ("source_file", "string"), ("byte_offset", "long"), ("line_number", "long")):
        if name not in parsed.columns:
            parsed = parsed.withColumn(name, F.lit(None).cast(kind))
    own = F.sha2("raw", 256)
    own = F.coalesce("content_hash", own) if "content_hash" in parsed.columns else own
    out = parsed.withColumns(
        {
            "case_id": F.lit(case_id), "source_id": F.lit(source_id), "parser_name": F.lit(parser), "parser_version": F.lit(version), "content_hash": own,
            "message": F.coalesce(F.nullif("message", F.lit("")), "raw"), "attributes": clean_attributes(F.col("attributes")),
            **{c: F.coalesce(c, F.lit("")) for c in ("timestamp_desc", "artifact", "artifact_long", "display_name")},
        }
    )
    return out.withColumn("event_id", event_id()).drop("raw")


def new_events(events: DataFrame, known: DataFrame) -> DataFrame:
    """Events not stored yet: re-reading a file adds nothing."""
    return events.join(known.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])


def _bounds(since: str | None, until: str | None) -> tuple[Column, dict[str, Column]]:
    """Which parsed rows stay, and the counters of all: parsed, malformed (null `ok`), out of range."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    inside = F.lit(True)
    if since:
        inside = inside & (F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until:
        inside = inside & (F.col("timestamp") < F.lit(until).cast("timestamp"))
    inside = F.coalesce(inside, F.lit(since is None and until is None))
    return ok & inside, {"parsed": F.count_if(ok & inside), "malformed": F.count_if(~ok), "out_of_range": F.count_if(ok & ~inside)}


def time_bounds(parsed: DataFrame, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows inside the bounds, and one row of counts: parsed, malformed (null `ok`), out of range. Each of the two reads the input; write_bounded reads it once."""
    keep, counters = _bounds(since, until)
    return parsed.where(keep), parsed.agg(*[c.alias(n) for n, c in counters.items()])


def write_bounded(parsed: DataFrame, path: str, since: str | None = None, until: str | None = None) -> dict[str, int]:
    """Writes the rows inside the bounds as Parquet and returns the counts of time_bounds, made while the rows are parsed: one pass."""
    keep, counters = _bounds(since, until)
    metrics, seen = [c.alias(n) for n, c in counters.items()], Observation()
    parsed.observe(seen, *metrics).where(keep).write.mode("overwrite").parquet(path)
    return observed(seen, lambda: parsed.agg(*metrics))


def attributes_of(**columns: Column) -> Column:
    """A map of named columns as text, blanks and nulls left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")))
