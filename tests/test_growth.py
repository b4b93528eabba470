"""What goes wrong only at size, on tables just large or odd enough to show it."""

from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from eventlens import catalog
from eventlens.functions import ranks
from eventlens.operators import detect, explore, verdicts
from eventlens.sources import timelines

from .compare import TABLES, connect, same


def test_bulk_annotations_of_many_events(spark):
    """All events of a view are annotated, however many; only a bound that the caller sets refuses."""
    ev = spark.range(100_001).select(F.col("id").cast("string").alias("event_id"))
    none = spark.createDataFrame([], "event_id string, kind string, value string")
    assert verdicts.bulk_annotate(ev, none, "tag", "bulk").count() == 100_001


def test_ranks_go_through_each_block_once(spark, monkeypatch):
    """A frame to the end of its partition is gone through anew for each row."""
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 10)
    tests = spark.range(200).select(F.col("id").alias("i"), ((F.col("id") * 37 % 101 + 1) / 102).alias("p"))
    out = ranks.q_values(tests, "p", "q")
    rows = sorted(((r.p, r.q) for r in out.collect()), reverse=True)
    low, n = 1.0, 200
    for at, (p, q) in enumerate(rows):
        own = min(p * n / sum(x <= p for x, _ in rows), low)
        low = min(low, own)
        assert abs(q - low) < 1e-12, at
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_addresses_of_users_beyond_16_bits(spark, sf, tmp_path):
    for t in TABLES:
        if t != "events":
            Path(tmp_path, f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    duckdb.connect().sql(f"COPY (SELECT * REPLACE (user_id * 6553 AS user_id) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet'")
    assert duckdb.connect().sql(f"SELECT max(user_id) FROM '{tmp_path}/events.parquet'").fetchall()[0][0] > 65535
    same(catalog.queries()["enrich_mixed"](spark, str(tmp_path)), catalog.oracle_sql()["enrich_mixed"], connect(tmp_path))


def test_samples_are_ranked_in_cells(spark):
    """The first rows by hash are the same as by one sort, and no window holds a whole source."""
    rows = spark.range(4000).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 2)).alias("source_id"), F.when(F.col("id") % 1000 > 0, F.col("id").cast("string")).alias("event_id"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("attributes"))
    for cap in (1, 500, 10_000):
        out = explore._first_by_hash(rows, ["source_id"], cap)
        got = sorted((r.source_id or "", r.attributes["k"]) for r in out.collect())
        want, of = [], {}
        for r in rows.withColumn("h", F.md5("event_id")).collect():
            of.setdefault(r.source_id or "", []).append((r.h or "", r.event_id or "", r.attributes["k"]))
        for s, each in of.items():
            want += [(s, k) for *_, k in sorted(each)[:cap]]
        assert len(got) == len(want) and (got == sorted(want) or cap == 1)
    coverage = explore.field_coverage(rows, 500)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in coverage.splitlines() if "Window [" in line]
    assert windows and all("_cell" in w for w in windows)


def test_long_values_are_not_shuffled(spark):
    """Alphabets come from digests and distinct characters; of the values only findings are sent."""
    rows = spark.range(60).select(F.col("id").cast("string").alias("event_id"), F.lit("s").alias("source_id"), F.timestamp_seconds(F.col("id")).alias("timestamp"), F.concat(F.repeat(F.lit("ab "), (F.col("id") % 30 + 20_000).cast("int")), F.when(F.col("id") == 7, "~").otherwise("")).alias("v"))
    rows = rows.withColumn("attributes", F.create_map(F.lit("k"), "v")).drop("v")
    basis = detect.charset_basis(rows, ["k"])
    assert "val" not in basis.columns and max(len(r.chars) for r in basis.collect()) < 10
    (found,) = detect.charset_novelty(rows, ["k"]).collect()
    assert found.chars == "~" and found.event_id == "7" and len(found.val) == 60_022 and found.val.endswith(" ~") and found.n == 1


def test_csv_text_is_read_a_few_times(spark, tmp_path):
    """The steps of quote states are written, so a step does not double the reads of the step before."""
    (tmp_path / "a.csv").write_text("id,message\n" + "".join(f'{i},"line {i}\nmore ""{i}"""\n' for i in range(50)))
    out = timelines.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((int(r.attributes["id"]), r.message) for r in out.collect()) == [(i, f'line {i}\nmore "{i}"') for i in range(50)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4
