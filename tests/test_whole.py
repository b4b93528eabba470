"""Operators give all their rows, also where there are more than the caps of the short queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens import catalog
from eventlens.operators import charts, detect
from eventlens.sources import text
from eventlens.streaming import streams


@pytest.fixture(scope="module")
def many(spark):
    """3,000 errors of one source, a second apart."""
    i = F.col("id")
    return spark.range(3000).select(
        i.cast("string").alias("event_id"), F.lit("s").alias("source_id"), i.alias("byte_offset"), i.alias("line_number"), F.timestamp_seconds(i).alias("timestamp"), F.lit("error").alias("artifact"),
        F.create_map(F.lit("x"), (i % 61).cast("string"), F.lit("y"), (i * 7 % 53).cast("string")).alias("attributes"),
    )


def test_all_occurrences_of_a_motif(many):
    assert detect.motif_occurrences(many, "artifact", ["error", "error"]).count() == 3000
    assert detect.motif_occurrences(many, "artifact", ["error", "error"], 100).count() == 101


def test_all_references(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.event_id for r in catalog.queries()["event_refs_all"](spark, sf).collect()}
    want = {str(r.event_id) for r in spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'").collect()}
    assert len(want) > 100 and got == want


def test_kendall_against_brute_force(spark, sf, many):
    row = charts.kendall_sample(many, "x", "y", 5000).first()
    i = np.arange(3000)
    x, y = np.sign(np.subtract.outer(i % 61, i % 61)), np.sign(np.subtract.outer(i * 7 % 53, i * 7 % 53))
    assert row.n == 3000 and row.tau == pytest.approx((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()), abs=1e-6)
    assert catalog.queries()["kendall_full"](spark, sf).first().n == spark.read.parquet(f"{sf}/events.parquet").count()


def test_streams_leave_their_rows_in_files(spark, many, tmp_path):
    rows = many.withColumn("timestamp", F.when(F.col("byte_offset") % 10 > 0, F.col("timestamp"))).select("event_id", "timestamp", "artifact")
    rows.unionByName(rows).write.parquet(f"{tmp_path}/in")
    run = lambda stream, name, mode: streams.run_to_end(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", mode)
    dated = run(streams.ingest(spark, f"{tmp_path}/in", rows.schema, late="1 day"), "dated", "append")
    assert dated.inputFiles() and dated.count() == 2700 and dated.where("timestamp IS NULL").isEmpty()
    undated = run(streams.undated(spark, f"{tmp_path}/in", rows.schema), "undated", "append")
    assert undated.inputFiles() and undated.count() == 300 and undated.where("timestamp IS NOT NULL").isEmpty()
    counts = run(streams.counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "artifact"), "counts", "complete")
    assert counts.inputFiles() and [r.n for r in counts.collect()] == [5400]


def test_offsets_over_part_files(spark, tmp_path):
    lines = [f"é line {i}" * (i % 5 + 1) for i in range(200)]
    spark.createDataFrame(list(enumerate(lines)), "i int, value string").repartitionByRange(4, "i").sortWithinPartitions("i").select("value").write.text(f"{tmp_path}/t")
    parts = text.read_with_offsets(spark, f"{tmp_path}/t")
    assert parts.select("source_file").distinct().count() == 4
    starts = np.cumsum([0] + [len(x.encode()) + 1 for x in lines])
    assert sorted(tuple(r) for r in text.as_one_file(parts).collect()) == [(int(a), i + 1, x) for i, (a, x) in enumerate(zip(starts, lines))]
