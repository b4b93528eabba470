"""Analysts' tables: bulk annotations, findings as annotations, dispositions, run snapshots."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import small


def bulk_annotate(df: DataFrame, annotations: DataFrame, kind: str, value: str, most: int | None = None) -> DataFrame:
    """annotations (event_id, kind, value) with one more for each event of a filtered view, however many; with most, a larger view is refused as a whole."""
    ids = df.select("event_id").distinct()
    if most is not None and ids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} events")
    return annotations.unionByName(ids.select("event_id", F.lit(kind).alias("kind"), F.lit(value).alias("value")))


def persist_findings(old: DataFrame, findings: DataFrame, detector: str) -> DataFrame:
    """System annotations (event_id, detector, confirmed): old ones of the detector go unless confirmed."""
    kept = old.where((F.col("detector") != detector) | F.col("confirmed"))
    new = findings.select("event_id").where("event_id IS NOT NULL").distinct().join(kept.where(F.col("detector") == detector).select("event_id"), "event_id", "left_anti")
    return kept.unionByName(new.select("event_id", F.lit(detector).alias("detector"), F.lit(False).alias("confirmed")))


def without_normal(findings: DataFrame, dispositions: DataFrame, detector: str) -> DataFrame:
    """Without findings that a `normal` verdict covers: by field and value, of this detector or all, or by event."""
    own = dispositions.where((F.col("kind") == "normal") & F.col("detector").isin(detector, "*"))
    by_value = small(own.where("field IS NOT NULL").select("field", "value").distinct())
    by_event = small(own.where("event_id IS NOT NULL").select("event_id").distinct())
    return findings.join(by_value, ["field", "value"], "left_anti").join(by_event, "event_id", "left_anti")


def with_verdicts(findings: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Findings with `dismissed` and `confirmed` flags by field and value."""
    flags = dispositions.where("field IS NOT NULL").groupBy("field", "value").agg((F.count_if(F.col("kind") == "dismissed") > 0).alias("dismissed"), (F.count_if(F.col("kind") == "confirmed") > 0).alias("confirmed"))
    out = findings.join(small(flags), ["field", "value"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("dismissed", "confirmed")})


def visible(findings: DataFrame, dispositions: DataFrame, include: bool = False) -> tuple[DataFrame, DataFrame]:
    """Findings to show, and one row that says how many are dismissed, whether shown or not."""
    flagged = with_verdicts(findings, dispositions)
    count = flagged.agg(F.count_if("dismissed").alias("dismissed"))
    return (flagged if include else flagged.where("NOT dismissed")), count


def disposition_stats(dispositions: DataFrame) -> DataFrame:
    """(day, normal, dismissed, confirmed, total): verdicts for each UTC day, and the running total."""
    days = dispositions.groupBy(F.to_date("at").cast("string").alias("day")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("normal", "dismissed", "confirmed")])
    to = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return days.withColumn("total", F.sum(F.col("normal") + F.col("dismissed") + F.col("confirmed")).over(to))


def snapshot(findings: DataFrame, detector: str, params: Mapping, windows: Mapping, dispositions: DataFrame) -> DataFrame:
    """Findings as rows of a run, with hashes of windows and dispositions in canonical JSON."""
    canonical = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    h = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = dispositions.select(F.sha2(F.to_json(F.struct(*sorted(dispositions.columns))), 256).alias("h"))
    # Order does not matter: the hashes' first 60 bits are summed.
    total = rows.agg(F.coalesce(F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"), F.count(F.lit(1)).alias("n"))
    head = total.select(F.lit(detector).alias("detector"), F.lit(canonical(params)).alias("params"), F.lit(h(canonical(windows))).alias("windows_hash"), F.sha2(F.concat_ws(":", "s", F.col("n").cast("string")), 256).alias("dispositions_hash"))
    return findings.crossJoin(F.broadcast(head))  # one row
