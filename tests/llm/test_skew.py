"""Operators of corpora on repeated ids, repeated rows and null ids, and models on held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import langid, mixing, neardup, packing, quality, urlfilter

from .test_operators import components_by_brute_force


def words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_repeated_ids_with_several_texts_in_large_buckets(spark, monkeypatch):
    """Texts of a family share bands; some ids have two of them, so an id must link through either."""
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(5)
    base = [f"word{i}" for i in rng.integers(0, 500, 150)]
    rows, sets = [], {}
    for i in range(60):
        own = list(base)
        for j in rng.integers(0, len(own), int(rng.integers(0, 9))):
            own[j] = f"new{rng.integers(0, 10_000)}"
        rows.append((100 + i % 45, " ".join(own)))
    # By brute force each text is a node of its own; texts of one id are then joined.
    nodes = [(n, text) for n, (_, text) in enumerate(rows)]
    links = components_by_brute_force(nodes)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, (doc_id, _) in enumerate(rows):
        a, b = find(("c", links[n][1])), find(("d", doc_id))
        parent[a] = b
    for _, (doc_id, _) in enumerate(rows):
        sets.setdefault(find(("d", doc_id)), set()).add(doc_id)
    want = {d: min(s) for s in sets.values() for d in s}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want


def test_many_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 50)
    rows = [(i, words(0, 30)) for i in range(300)] + [(300 + i, words(i + 1, 30)) for i in range(200)] + [(600 + i, words(i + 1, 30)) for i in range(20)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(300)} | {300 + i: 300 + i for i in range(200)} | {600 + i: 300 + i for i in range(20)}


def test_null_and_repeated_ids_do_not_fill_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 4000)
    docs = spark.range(600, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(words(0, 20)).alias("text"))
    out = packing.packed_rows(docs, length=64)
    per = [r["count"] for r in out.select("shard", F.explode("doc_ids")).groupBy("shard").count().collect()]
    assert len(per) >= 6 and max(per) <= 300
    again = packing.packed_rows(docs.withColumn("doc_id", F.lit(7)).withColumn("text", F.concat("text", F.lit(" "), F.monotonically_increasing_id() % 40)), length=64)
    assert again.select("shard").distinct().count() > 10


def test_repeated_ids_bring_one_row_to_the_fit(spark):
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(7, "good text here")] * 500 + [(8, "bad bad bad")] * 500, "doc_id long, text string")
    once = quality.fit(docs.distinct(), labels)
    assert np.array_equal(quality.fit(docs, labels), once) and np.abs(once).sum() > 0


def test_quality_scores_are_sparse_dot_products(spark):
    """Each score again, feature by feature, from the weights alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    w = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.score(docs, w).collect():
        index, at = quality.features([rows[r.doc_id]])
        z = float(w[-1]) + sum(float(w[i]) for i in index) / max(len(index), 1) ** 0.5
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-6


def test_language_scores_are_mean_position_probabilities(spark):
    """One document at a time and one byte at a time, in plain steps."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12)
    net = langid.fit(docs)
    for r in docs.where(F.col("text").rlike(r"\p{L}")).collect():
        raw = r.text.lower().encode()[:700]
        total = np.zeros(len(net.langs))
        for lo in range(0, len(raw), langid.READ):
            part = raw[lo : lo + langid.READ]
            states = []
            for way, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
                h, own = np.zeros(langid.HIDDEN), {}
                for t in order:
                    a, g, k = net.embed[way][part[t]].astype(float), net.state[way].astype(float) @ h, langid.HIDDEN
                    keep, reset = np.clip(a[:k] + g[:k], -1, 1), np.clip(a[k : 2 * k] + g[k : 2 * k], -1, 1)
                    n = np.clip(a[2 * k :] + g[2 * k :] + reset * g[2 * k :], -1, 1)
                    h = 0.5 * (h + n + keep * (h - n))
                    own[t] = h
                states.append(own)
            for t in range(len(part)):
                z = net.out[0] @ states[0][t] + net.out[1] @ states[1][t] + net.bias[:, 0]
                e = np.exp(z - z.max())
                total += e / e.sum()
        got, _ = langid.probabilities(net, [raw])
        assert np.allclose(got[0], total / max(len(raw), 1), atol=1e-4)


def test_long_training_texts_are_read_to_their_ends(spark):
    """Both texts begin alike; only what follows tells the languages apart."""
    head = "zz " * 400
    docs = spark.createDataFrame([(3 * i, head + ("aba cab " if i % 2 else "xyx yzz ") * 2000, "a" if i % 2 else "x") for i in range(60)], "doc_id long, text string, lang string")
    net = langid.fit(docs)
    p, _ = langid.probabilities(net, [b"aba cab " * 30, b"xyx yzz " * 30])
    assert net.langs[p[0].argmax()] == "a" and net.langs[p[1].argmax()] == "x"


def test_trees_on_held_out_urls(spark):
    """Trees that never saw a quarter of the ruled URLs judge these; suffix statistics must not hold a row's own verdict."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = urlfilter.judge(pages, learn=F.col("page_id") % 4 != 0).where("page_id % 4 = 0 AND rule IS NOT NULL").collect()
    right = [(r.method_score >= 0.5) == (r.verdict == "block") for r in out]
    blocked = np.mean([r.verdict == "block" for r in out])
    assert len(out) > 50 and np.mean(right) > max(0.8, blocked, 1 - blocked) - 0.02


def test_urls_of_odd_rows(spark):
    long = "http://a.com/en/" + "x" * 200_000 + "?a=1&b=2"
    rows = [(1, long), (1, long), (None, "http://b.org/es/1"), (None, None), (2, "http://b.org/fr/" + "é%" * 50_000)]
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(out) == 5 and [r.verdict for r in out if r.page_id == 1] == ["block", "block"]
    assert sorted(r.rule or "" for r in out) == ["", "", "com/en/", "com/en/", "org/es/"]


@pytest.mark.parametrize("blocks", [{"a": 4, "b": 30, "c": 10}, {"a": 40, "b": 3, "c": 1}, {"a": 1, "b": 1, "c": 50}])
def test_one_schedule_whatever_the_sum_of_weights(spark, monkeypatch, blocks):
    """The order is the same where a whole period is made and where the schedule is gone through."""
    rows = [(s * 1000 + i, "t", "abc"[s]) for s, n in enumerate(blocks.values()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = lambda: [(r.source, r.doc_id) for r in mixing.mix(docs, {"a": 3, "b": 2, "c": 1}, block=1).orderBy("slot", "place").collect()]
    whole = order()
    monkeypatch.setattr(mixing, "PERIOD", 2)
    assert order() == whole and len(whole) == len(rows)


def test_repeated_rows_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT", 50)
    docs = spark.range(6000, numPartitions=6).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("a").alias("source"))
    docs = docs.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source")))
    got = mixing.mix(docs, {"a": 2, "b": 1}).collect()
    assert len(got) == 6500 and len({(r.slot, r.place) for r in got}) == 6500
    assert {(r.doc_id, r.text) for r in got} == {(7, "same text")} | {(i, f"text {i}") for i in range(500)}
    counted = mixing.numbered(docs, "n", "source", {"a": 6250, "b": 250})
    assert sorted(r.n for r in counted.where("source = 'a'").collect()) == list(range(6250))
    windows = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in windows


def test_equal_rows_go_to_many_shards(spark):
    docs = spark.range(6000, numPartitions=6).select(F.lit(7).cast("long").alias("doc_id"), F.lit(words(0, 200)).alias("text"))
    size = 6000 * len(words(0, 200))
    per = [r["count"] for r in packing.packed_rows(docs, shard_bytes=size // 12).select("shard", F.explode("doc_ids")).groupBy("shard").count().collect()]
    assert len(per) >= 10 and sum(per) == 6000 and max(per) < 1500
