"""Writers and case transfer: Parquet, JSON lines, CSV, export and import of cases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import EVENT_SCHEMA
from ..functions.storage import observed


def write_parquet(events: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Events partitioned by case and source; a source written again replaces only its own partition."""
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("case_id", "source_id").parquet(path)


def _notes(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value"))).alias("annotations"))


def json_rows(events: DataFrame, annotations: DataFrame) -> DataFrame:
    """(line): each event with its annotations as one JSON object; times in ISO form with milliseconds, UTC."""
    out = events.join(_notes(annotations), "event_id", "left").withColumn("annotations", F.coalesce("annotations", F.array().cast("array<struct<kind:string,value:string>>")))
    out = out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return out.select("event_id", F.to_json(F.struct(*sorted(out.columns)), {"ignoreNullFields": "false"}).alias("line"))


def write_jsonl(events: DataFrame, annotations: DataFrame, path: str, offsets: Mapping[str, float] | None = None) -> None:
    """A folder of JSON lines and a trailer. Events are counted where they are read and lines where they are written, in one pass; as many must come out as went in."""
    spark, n = events.sparkSession, F.count(F.lit(1)).alias("n")
    asked, written = Observation(), Observation()
    lines = json_rows(events.observe(asked, n), annotations).select("line").observe(written, n)
    lines.write.mode("overwrite").text(path)
    read, made = observed(asked, lambda: events.agg(n))["n"], observed(written, lambda: spark.read.text(path).agg(n))["n"]
    if made != read:
        raise RuntimeError(f"{made} of {read} events were written")
    trailer = F.to_json(F.struct(F.lit(made).alias("written"), F.lit(str(dict(offsets or {}))).alias("offsets")))
    spark.range(1).select(trailer.alias("line")).coalesce(1).write.mode("overwrite").text(f"{path}-trailer")


def csv_rows(events: DataFrame, annotations: DataFrame) -> DataFrame:
    """The same flattened: tags by `;`, attributes as JSON, user tags, comments and anomaly findings."""
    of = lambda kind: F.array_join(F.transform(F.filter("annotations", lambda a: a["kind"] == kind), lambda a: a["value"]), ";")
    out = events.join(_notes(annotations), "event_id", "left").withColumn("annotations", F.coalesce("annotations", F.array().cast("array<struct<kind:string,value:string>>")))
    ordered = F.map_from_entries(F.array_sort(F.map_entries("attributes")))
    return out.select(
        "event_id", "source_id", F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")).alias("timestamp"), "artifact", "message", F.array_join("tags", ";").alias("tags"), F.to_json(ordered).alias("attributes"), of("tag").alias("user_tags"), of("comment").alias("comments"), of("anomaly").alias("anomaly_findings")
    )


def write_csv(events: DataFrame, annotations: DataFrame, path: str) -> None:
    csv_rows(events, annotations).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def export_case(events: DataFrame, case_id: str, path: str) -> None:
    """All events of a case by source."""
    events.where(F.col("case_id") == case_id).write.mode("overwrite").partitionBy("source_id").parquet(path)


def same_schema(rows: DataFrame) -> None:
    want = {f.name: f.dataType.simpleString() for f in EVENT_SCHEMA}
    wrong = {n: t for n, t in rows.dtypes if n in want and want[n] != t} | {n: None for n, _ in rows.dtypes if n not in want}
    if wrong:
        raise ValueError(f"columns differ from the event schema: {wrong}")


def import_case(rows: DataFrame, case_id: str, sources: Mapping[str, str]) -> DataFrame:
    """Events under fresh case and source ids (a small map); embedding marks are blanked. Rows of unmapped sources are refused."""
    same_schema(rows)
    ids = rows.sparkSession.createDataFrame(list(sources.items()), "source_id string, new_id string")
    out = rows.join(F.broadcast(ids), "source_id", "left")
    checked = F.when(F.col("new_id").isNull(), F.raise_error(F.concat(F.lit("unmapped source "), "source_id"))).otherwise(F.col("new_id"))
    blank = {c: F.lit("") for c in ("embedding_model", "embedding_config_hash") if c in rows.columns}
    return out.withColumns({"source_id": checked, "case_id": F.lit(case_id), **blank}).drop("new_id")


def without_source(events: DataFrame, source_id: str) -> DataFrame:
    return events.where(F.col("source_id") != source_id)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
