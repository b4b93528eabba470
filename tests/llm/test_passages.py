"""Repeated passages, vector codes and ranked search against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import lexical, queries, repeats, vectorcodes

from ..compare import connect, same

DOCS = "doc_id long, text string"
CLASH = ("mini", "words", "place", "low", "high", "found", "owner", "runs", "id", "hash", "text_hash", "n", "total", "ids", "counts", "item", "term", "rank", "score", "vec", "code", "error", "label_error", "part", "entry", "kept")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


@pytest.mark.parametrize("name", ["op11_repeated_passages", "op12_vector_codes", "op13_ranked_search"])
def test_queries_give_the_rows_of_their_sql(name, spark, sf):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], connect(sf))


# Repeated passages.
def plain_kept(rows, span):
    """(doc_id, n_words, n_removed, kept) of each row."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    owner = {}
    for d, ws in words:
        for i in range(len(ws) - span + 1):
            if d is not None:
                owner[tuple(ws[i : i + span])] = min(owner.get(tuple(ws[i : i + span]), d), d)
    out = []
    for d, ws in words:
        gone = {j for i in range(len(ws) - span + 1) if d is not None and owner[tuple(ws[i : i + span])] < d for j in range(i, i + span)}
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def passages():
    """Copies, near copies, a passage between other words, few words again and again, white space of all kinds."""
    rng = random.Random(5)
    text = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    line, base = text(40, 900), text(120, 900)
    rows = [(i, text(60, 900)) for i in range(30)]
    rows += [(100 + i, f"{text(7, 900)}  {line}\t\n{text(9, 900)}") for i in range(40)]
    rows += [(200 + i, base) for i in range(20)]
    for i in range(20):
        ws = base.split()
        ws[rng.randrange(120)] = f"new{i}"
        rows.append((300 - i, " ".join(ws)))
    rows += [(400, "a " * 500), (401, "a " * 300), (402, "a b " * 200), (403, "é ü a\x0bb " * 30), (404, "é ü a\x0cb " * 20)]
    return rows + [(None, base), (None, line), (500, None), (501, ""), (502, "few words"), (220, base), (120, text(30, 900)), (120, line)]


@pytest.mark.parametrize("settings", [{}, {"heavy": 5}, {"heavy": 5, "held": 0}, {"known": 0, "heavy": 5}, {"span": 6, "mini": 2}, {"span": 3, "mini": 3, "heavy": 2}])
def test_every_repeated_window_is_removed(spark, settings, monkeypatch):
    rows = passages()
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    got = repeats.remove_repeats(df, **settings).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_kept(rows, settings.get("span", 13)), key=repr)


def test_windows_are_sorted_in_portions(spark, monkeypatch):
    rows = [("x " * 20 + f"y{i % 7} " * 15, i) for i in range(60)]
    packed = [t.strip() for t, _ in rows]
    monkeypatch.setattr(repeats, "LONGEST", 4)
    text, place, low = repeats.owners(packed, np.array([d for _, d in rows]))
    want = plain_kept([(d, t) for t, d in rows], 13)
    gone = defaultdict(set)
    for t, p, d in zip(text, place, low, strict=True):
        if d < rows[t][1]:
            gone[t] |= set(range(p, p + 13))
    assert [len(gone[i]) for i in range(60)] == [w[2] for w in want]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    spans = repeats.spans
    monkeypatch.setattr(repeats, "spans", lambda texts: (*spans(texts)[:3], np.zeros_like(spans(texts)[3]), spans(texts)[4]))
    packed = [" ".join(f"a{i}" for i in range(13)), " ".join(f"b{i}" for i in range(13)), " ".join(f"a{i}" for i in range(14))]
    _, _, low = repeats.owners(packed, np.array([3, 2, 1]))
    assert low.tolist() == [1, 2, 1, 1]


def test_long_texts_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, "start " + long + " end"), (3, " ".join(f"w{i}" for i in range(100, 160)))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == (200_000, 0, long) and got[2] == (200_002, 200_000, "start end") and got[3] == (60, 60, "")
    none = repeats.remove_repeats(spark.createDataFrame([], DOCS))
    assert none.columns == ["doc_id", "n_words", "n_removed", "kept"] and none.count() == 0


# Vector codes.
def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n = len(kept[0][1]) // parts if kept else 0
    cut = lambda v: [tuple(v[p * n : (p + 1) * n]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[near(cut(v)[p], book)[1]].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(held[i]) for c in zip(*held[i], strict=True)) if i in held else e for i, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], Counter()
    for i, v, lab in kept:
        found = [near(x, b) for x, b in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{c:02x}" for _, c in found), sum(d for d, _ in found), lab))
        sums[lab] += out[-1][2]
    return [(i, c, e, sums[lab], digest) for i, c, e, lab in out]


def vectors(n, dim=8, clusters=12, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 0.2 + rng.normal(size=(n, dim)) * 0.03
    return [(i, x.tolist(), int(i % 3) if i % 7 else None) for i, x in enumerate(v)]


def test_codes_are_those_of_plain_rounds(spark):
    rows = vectors(400) + [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, None), (5, [0.0] * 8, None), (None, [0.1] * 8, None), (None, [0.1] * 8, 2)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    for entries, rounds in ((16, 4), (256, 2), (1, 1)):
        got = vectorcodes.with_label_error(vectorcodes.encode(df, entries=entries, rounds=rounds)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(plain_codes(rows, entries=entries, rounds=rounds), key=repr)


def test_very_large_components_are_exact(spark):
    rows = [(i, [x * (-1) ** i for x in v], 0) for i, v in enumerate([[1e6, 2.5, -3.0, 0.1], [1e6 + 1, 2.5, -3.5, 0.1], [4e5, -2e5, 1.0, 0.5], [1e9, 0.0, 1e-9, -1e-9]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectorcodes.with_label_error(vectorcodes.encode(df, entries=2)).collect()
    want = [(i, c, min(e, 2**63 - 1), s, h) for i, c, e, s, h in plain_codes(rows, entries=2)]
    assert [(r.vec_id, r.code, r.error, r.codebooks_sha256) for r in sorted(got)] == [(i, c, e, h) for i, c, e, _, h in sorted(want)]


def test_lengths_that_differ_and_empty_tables(spark):
    rows = [(1, [], 0), (2, [0.5], 0), (3, [0.1, 0.2, 0.3, 0.4, 0.5], 0), (4, [0.1, 0.2, 0.3, 0.4, 0.6], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.code, r.error) for r in vectorcodes.encode(df).collect()}
    assert got == {1: ("00000000", 0), 2: ("00000000", 0), 3: ("00000000", 0), 4: ("00000001", 0)}
    assert vectorcodes.with_label_error(vectorcodes.encode(df.where("false"))).count() == 0
    assert vectorcodes.borders(5) == [0, 2, 3, 4, 5]


@pytest.mark.parametrize("shift, dtype", [(0, np.int64), (3, np.int64), (9, np.int64), (5, object)])
def test_cells_leave_out_no_nearest_entry(shift, dtype):
    rng = np.random.default_rng(shift)
    book = rng.integers(-300, 300, (40, 5))
    book[7] = book[3]
    parts = np.concatenate((rng.integers(-400, 400, (300, 5)), book, book[:1].repeat(3, axis=0)))
    memo = vectorcodes.Memo(book.astype(dtype), shift, remember=100)
    code, error = memo.nearest(parts.astype(dtype))
    far = ((parts[:, None] - book) ** 2).sum(axis=2)
    assert code.tolist() == far.argmin(axis=1).tolist() and error.tolist() == far.min(axis=1).tolist()
    again = memo.nearest(parts[:50].astype(dtype))
    assert again[0].tolist() == code[:50].tolist()
    assert memo.measured <= (len(parts) + 50) * 40
    if shift == 3:
        assert memo.measured < 0.5 * len(parts) * 40


# Ranked search.
def plain_ranks(docs, items, k=10):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, every = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    own = defaultdict(Counter)
    for i, t in set(items):
        own[i].update(terms(t))
    out = []
    for i, q in own.items():
        scored = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // every
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("terms, tile", [(500_000, 1024), (20, 7)])
def test_ranks_are_those_of_plain_scores(spark, terms, tile, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 3)
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("the of And é1 x9 Zoo ünd q-r b_c 12 Ärger".split() + [f"t{j}" for j in range(60)]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(200)] + [(i, "same words here") for i in range(300, 340)] + [(7, "same words here"), (None, "same words here"), (400, None), (401, ""), (402, "-- !!")]
    items = [(i, text(12)) for i in range(12)] + [(20, "same"), (21, None), (22, "nothingof that"), (20, "same"), (0, "t1 t1 t1"), (None, "words t5")]
    df = clashing(spark.createDataFrame(docs, DOCS).repartition(5))
    got = lexical.rank(df, clashing(spark.createDataFrame(items, "item_id long, text string")), 10, terms)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranks(docs, items)


def test_nothing_to_rank(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "c")], "item_id long, text string")
    for d, i in ((docs, items), (docs.where("false"), items), (docs, items.where("false")), (docs.where("false"), items.where("false"))):
        got = lexical.rank(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_products_stay_exact_beyond_double_precision():
    rng = np.random.default_rng(0)
    weights = rng.integers(0, 1 << 31, (5, 40))
    weights[0, 3], weights[1, 4] = (1 << 34) + 1, (1 << 33) + 3
    impacts = rng.integers(0, lexical.IMPACT, (40, 30))
    want = weights.astype(object) @ impacts.astype(object)
    assert (lexical.products(weights, impacts) == want).all()


def test_lengths_beyond_64_bits():
    n = np.array([3, 10**15])
    assert lexical.lengths(n, 10**9, 10**16).tolist() == [25 + 75 * x * 10**9 // 10**16 for x in n.tolist()]


def test_terms_are_whole_and_folded():
    texts = ["A-b_C9 É\x7fé", None, "", "x" * 100_000 + " y", "\x00a"]
    terms, at = lexical.cut(texts)
    assert [t.decode() for t in terms.to_pylist()] == ["a", "b", "c9", "É", "é", "x" * 100_000, "y", "a"]
    assert at.tolist() == [0, 5, 5, 5, 7, 8]
