"""Nearest neighbours on near-copies, ties, extremes and several shards."""

import numpy as np
import pytest

from eventlens.llm import ann


def exact_neighbours(v, ids, queries, k=5):
    """For each query the k best (vec_id, score), from all vectors."""
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    at = {i: n for n, i in enumerate(ids)}
    out = {}
    for q in queries:
        cos = unit @ unit[at[q]]
        out[q] = sorted(((-round(c, 13), i) for i, c in zip(ids, cos, strict=True) if i != q))[:k]
    return out


@pytest.mark.parametrize("n, clusters, noise, shard", [(4000, 40, 1e-4, 8192), (8192, 40, 1e-4, 8192), (3000, 3, 1e-4, 1000), (3000, 60, 0.3, 500)])
def test_recall_on_near_copies(spark, n, clusters, noise, shard):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), 5, shard).collect()
    want = exact_neighbours(v, range(n), range(0, n, 50))
    assert len(got) == 5 * len(want)
    assert sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got) / len(got) >= 0.95


@pytest.mark.parametrize("dim, n, kind", [(128, 5000, "spread"), (256, 4000, "spread"), (768, 1500, "spread"), (256, 4000, "clusters"), (256, 4000, "low rank")])
def test_walks_are_as_wide_as_the_vectors_need(spark, dim, n, kind):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(n, dim))
    if kind == "clusters":
        v = rng.normal(size=(50, dim))[rng.integers(0, 50, n)] + 0.2 * v
    elif kind == "low rank":
        v = rng.normal(size=(n, 12)) @ rng.normal(size=(12, dim))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), 5).collect()
    want = exact_neighbours(v, range(n), range(0, n, 50))
    assert len(got) == 5 * len(want)
    assert sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got) / len(got) >= 0.95


@pytest.mark.parametrize("n", [40, 400])
def test_ties_go_to_the_smallest_ids_whatever_their_number(spark, n):
    rows = [(i, [float(1 << (i % 8)) * (1 + i // 8), 0.0, 0.0]) for i in range(n)] + [(n + i, [1.0, 0.5 + i, 0.1]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id IN (0, 7, 30)"), 5).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 7, 30)}
    assert by == {0: [1, 2, 3, 4, 5], 7: [0, 1, 2, 3, 4], 30: [0, 1, 2, 3, 4]}


def test_extreme_vectors_have_finite_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 4))
    size = [1e-200, 1.0, 1e200, 1e-310]
    rows = [(i, (x * size[i % 4]).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id < 4"), 29).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert len(got) == 4 * 29 and all(abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-9 for r in got if r.query_id % 4 < 3 and r.vec_id % 4 < 3)


def test_repeated_ids_do_not_fill_the_answers(spark):
    rows = [(1, [1.0, 0.001 * i]) for i in range(300)] + [(i, [1.0, 1.0 + i]) for i in range(2, 12)] + [(50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 50"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]
