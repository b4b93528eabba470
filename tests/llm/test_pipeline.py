"""The corpus pipeline, stage by stage, against plain versions of each."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from eventlens.llm import decontam, langid, mixing, packing, tokens

from .test_operators import DOCS, components_by_brute_force


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{top}/{i}")
        out.append(spark.read.parquet(f"{top}/{i}"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_language_stage(stages):
    before, after = stages[0].collect(), {r.doc_id for r in stages[1].collect()}
    net = langid.fit(stages[0])
    p, _ = langid.probabilities(net, [(r.text or "").lower().encode() for r in before])
    want = {r.doc_id for r, q in zip(before, p, strict=True) if re.search(r"[^\W\d_]", r.text or "") and q.max() >= C.least_score(len(net.langs))}
    assert after == want


def test_the_least_score_grows_with_chance():
    assert C.least_score(4) == pytest.approx(0.35) and C.least_score(2) > 0.5 and 0.05 < C.least_score(20) < 0.2 and C.least_score(1) == 1


def test_documents_that_fit_no_language_go(spark, sf):
    """Half of the texts of two learnt languages each in one document is a toss-up; a document of one language is not."""
    a, b = "aba cab bac ", "xyx yzz zxy "
    docs = spark.createDataFrame([(3 * i, (a if i % 2 else b) * 60, "a" if i % 2 else "x", "s", 1) for i in range(60)] + [(1000, (a + b) * 40, "a", "s", 1), (1001, "123 --", "a", "s", 1)], DOCS)
    kept = {r.doc_id for r in C.language(spark, docs, sf).collect()}
    assert set(range(0, 180, 3)) <= kept and 1001 not in kept


def test_near_duplicate_stage(stages):
    want = components_by_brute_force([(r.doc_id, r.text) for r in stages[1].collect()])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_decontamination_stage(spark, sf, stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(len(w), decontam.SPAN)
        runs |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in runs}
    dirty = lambda t: any(tuple(w[i : i + n]) in runs for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))
    assert {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect() if not dirty(r.text)}


def test_mixing_stage_keeps_all_in_order(stages):
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()}
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mix(stages[3]).collect()}
    rows, position = C._position(stages[4])
    got = [r.doc_id for r in rows.select("doc_id", position.alias("p")).orderBy("p").collect()]
    assert got == sorted(got, key=place.get)


def test_packing_stage(stages):
    own = tokens.Pieces(tokens.model_path())
    rows, position = C._position(stages[4])
    shard = {r.doc_id: r.p // C.SHARD_DOCS for r in rows.select("doc_id", position.alias("p")).collect()}
    want = {r.doc_id: own.model.encode(r.text) for r in stages[4].collect()}
    got = {}
    for r in stages[5].collect():
        for d, p, s in zip(r.doc_ids, r.pieces, packing.unpack(r.tokens, r.cu_seqlens), strict=True):
            assert r.shard.split("-")[0] == f"{shard[d]:09d}"
            got.setdefault(d, {})[p] = s
    assert {d: np.concatenate([x[p] for p in sorted(x)]).tolist() for d, x in got.items()} == {d: t for d, t in want.items() if t}


def test_positions_and_repeated_ids(spark, sf, tmp_path):
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "other words that stand alone here", "en", "a", 1), (1, "other words that stand alone here", "en", "a", 1), (2, "one two three four five six", "en", "a", 1)]
    out = C.near_duplicates(spark, spark.createDataFrame(rows, DOCS), sf)
    assert sorted((r.doc_id, r.text[:3]) for r in out.collect()) == [(1, "one"), (1, "oth")]
    spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("_file", "_row", "_n", "_before")}).repartition(2).write.parquet(f"{tmp_path}/x")
    placed, position = C._position(spark.read.parquet(f"{tmp_path}/x"))
    assert sorted(r.p for r in placed.select(position.alias("p")).collect()) == [0, 1, 2, 3] and {r._row for r in placed.collect()} == {"x"}


def test_run_and_awkward_rows(spark, sf, tmp_path):
    assert C.run(spark, sf).count() > 0
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "one two three four five six", "en", "a", 1), (2, "one two three four five six", "en", "a", 1), (3, "one two three four five six", "en", None, 1), (4, "!! 12", "en", "a", 1), (None, "words without an id", "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i == 1:
            assert sorted(r.doc_id or -1 for r in docs.collect()) == [-1, 2]
    assert sorted(d for r in docs.collect() for d in r.doc_ids) == [-1, 2]
    empty = spark.createDataFrame([], DOCS)
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, empty, sf).write.parquet(f"{tmp_path}/empty{i}")
        empty = spark.read.parquet(f"{tmp_path}/empty{i}")
    assert empty.withColumn("x", F.lit(1)).count() == 0
