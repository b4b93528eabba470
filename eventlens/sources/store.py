"""The stored event table: partitions by case and source, files in order of time, thin reads before wide ones.

Row groups hold neighbouring times and carry Bloom filters of event ids, so a read by a time span or by a few ids
skips most of them. A page is found on thin columns first; then only the row groups of its rows are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.explore import newest_first
from ..plans.filters import EventQuery, predicate

#: Rows of a file, and bytes of a row group, at most.
ROWS, GROUP_BYTES = 1_000_000, 16 << 20
#: Most ids that are looked up by Bloom filters at once; more are looked up in portions.
IDS = 1000


def write_store(events: DataFrame, path: str, rows_per_file: int = ROWS, group_bytes: int = GROUP_BYTES) -> None:
    """Events clustered by time inside case and source; a source written again replaces only its own partition."""
    order = ["case_id", "source_id", "timestamp", "event_id"]
    # Ranges of all four columns split a large source over many tasks.
    rows = events.repartitionByRange(*order).sortWithinPartitions(*order)
    bloom = {"parquet.bloom.filter.enabled#event_id": "true", "parquet.bloom.filter.expected.ndv#event_id": str(rows_per_file), "parquet.block.size": str(group_bytes), "parquet.enable.dictionary#event_id": "false"}
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).options(**bloom)
    writer.partitionBy("case_id", "source_id").parquet(path)


def by_ids(spark: SparkSession, path: str, ids: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Events with the given ids (a bounded list): row groups whose Bloom filters know none of them are skipped."""
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(max(IDS, int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold", "10")))))
    table = spark.read.parquet(path)
    table = table.select(*columns) if columns else table
    out = table.where("false")
    ids = sorted(set(ids))
    for lo in range(0, len(ids), IDS):
        part = table.where(F.col("event_id").isin(*ids[lo : lo + IDS]))
        out = part if lo == 0 else out.unionByName(part)
    return out


def _held(rows: Sequence) -> Column:
    """The partitions and the time span of some thin rows, as conditions that prune files and row groups."""
    times = [r.timestamp for r in rows if r.timestamp is not None]
    undated = any(r.timestamp is None for r in rows)
    ts = F.col("timestamp")
    span = ts.between(F.lit(min(times)), F.lit(max(times))) if times else F.lit(False)
    return F.col("source_id").isin(*sorted({r.source_id for r in rows})) & ((span | ts.isNull()) if undated else span)


def page(spark: SparkSession, path: str, q: EventQuery, limit: int) -> DataFrame:
    """One page of a filtered store, newest first, with place and whether more rows follow.

    First the page's keys are read from thin columns (limit + 1 rows come to the driver); the second read has their partitions,
    time span and ids as pushed filters.
    """
    thin = spark.read.parquet(path).where(predicate(q)).select("event_id", "timestamp", "source_id")
    keys = thin.orderBy(*newest_first()).limit(limit + 1).collect()
    shown, more = keys[:limit], len(keys) > limit
    if not shown:
        return spark.read.parquet(path).where("false").withColumns({"place": F.lit(0), "more": F.lit(False)})
    places = spark.createDataFrame([(r.event_id, i, more) for i, r in enumerate(shown, 1)], "event_id string, place int, more boolean")
    wide = by_ids(spark, path, [r.event_id for r in shown]).where(_held(shown))
    return wide.join(F.broadcast(places), "event_id").orderBy("place")


def _folder(spark: SparkSession, path: str, **values: str) -> tuple[JavaObject, JavaObject]:
    """The file system and the folder of a partition."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *(f"{k}={name(v)}" for k, v in values.items())]))
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def delete_source(spark: SparkSession, path: str, case_id: str, source_id: str) -> bool:
    """Deletes a source's partition from the store; false if there was none. Files of other sources are not touched.

    The partition is first given a name that readers skip, in one step, and deleted after that. A delete that was stopped half-way has
    either changed nothing or left such a hidden folder: calling it again ends it.
    """
    system, folder = _folder(spark, path, case_id=case_id, source_id=source_id)
    # Readers skip names with an underscore, but not if they look like a partition's.
    hidden = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.getParent(), f"_deleted-{folder.getName().partition('=')[2]}")
    left = system.exists(hidden)
    if left:
        system.delete(hidden, True)
    there = system.exists(folder)
    if there and not system.rename(folder, hidden):
        raise RuntimeError(f"{folder} could not be renamed")
    if there:
        system.delete(hidden, True)
    return there or left
