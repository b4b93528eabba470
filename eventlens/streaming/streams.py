"""Structured Streaming forms: ingest without repeats, windowed counts, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def ingest(spark: SparkSession, path: str, schema, parse: Callable[[DataFrame], DataFrame] = lambda df: df, late: str = LATE) -> DataFrame:
    """Dated events from files as they arrive, each id once within the watermark; undated ones come by their own stream."""
    rows = parse(spark.readStream.schema(schema).parquet(path)).where("timestamp IS NOT NULL")
    return rows.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"])


def undated(spark: SparkSession, path: str, schema, parse: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Events without a time from files as they arrive, each id once: no watermark can pass them, so their ids stay in the state."""
    return parse(spark.readStream.schema(schema).parquet(path)).where("timestamp IS NULL").dropDuplicates(["event_id"])


def counts(events: DataFrame, series: str, length: str = "1 hour", late: str = LATE) -> DataFrame:
    """(series, start, n): events by tumbling window; a window is final once the watermark has passed it."""
    out = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", length).alias("w"), series).agg(F.count(F.lit(1)).alias("n"))
    return out.select(series, F.unix_seconds("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(key, start, end, n): runs of events of a key without a longer gap."""
    out = events.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.unix_millis("w.start").alias("start"), F.unix_millis("w.end").alias("end"), "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows, by Parquet files under path, a shared folder that is not there yet.

    Executors write the files: no row comes to the driver. In complete mode every batch has all rows and replaces those of the batch before.
    """
    out, spark = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True), stream.sparkSession
    if mode == "append":
        out.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    last: list[int] = []

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{i % 2}")
        last[:] = [i % 2]

    out.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}") if last else spark.createDataFrame([], stream.schema)
