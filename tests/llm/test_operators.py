"""Corpus operators against brute force, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens.llm import ann, decontam, hashing, html, langid, mixing, neardup, packing, quality, queries, tokens, urlfilter

from ..compare import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, LONG, "en", "b", 9), (5, "one two", "de", "b", 7), (5, "one two", "de", "b", 7), (6, "One TWO", "de", None, 7), (None, "no id here at all", None, "a", 1), (7, "123 !!", "fr", "c", 6), (8, LONG + " tail", "en", "b", 9)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("score", "rep", "a", "b", "node", "component", "text_hash", "id", "hash", "slot", "place", "number", "_rank", "shard", "predicted", "held_out", "n_words", "bucket", "piece")})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(df):
    return df.where("false")


# Hashing.
def test_word_hashes_are_those_of_words():
    texts = ["The quick  brown\tfox", None, "", " the", "É é x" * 3, "a\x0bb\x0cc"]
    h, at = hashing.words(texts)
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) for t in texts]
    assert list(np.diff(at)) == [len(w) for w in want]
    seen = {}
    for word, value in zip([w for ws in want for w in ws], h, strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_words_over_block_borders(monkeypatch):
    texts = ["abc defg " * 50, "x" * 100, "hi there"]
    whole = hashing.words(texts)
    monkeypatch.setattr(hashing, "BLOCK", 16)
    assert all(np.array_equal(a, b) for a, b in zip(whole, hashing.words(texts), strict=True))


# Near-duplicates.
def components_by_brute_force(rows, percent=85):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets[doc_id] = frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == components_by_brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicates_of_a_family(spark, monkeypatch):
    """Copies of one text with more and more words changed: links lie around the threshold."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in rng.integers(0, 500, 150)]
    rows = []
    for i in range(70):
        own = list(base)
        for j in rng.integers(0, len(own), int(rng.integers(0, 9))):
            own[j] = f"new{rng.integers(0, 10_000)}"
        rows.append((100 + i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_brute_force(rows)


def test_near_duplicates_of_awkward_rows(awkward):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(awkward).collect())
    assert got == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 29_996, 4, True): 1, (5, 1, 5, True): 2, (6, 1, 5, False): 1, (None, 1, None, True): 1, (7, 1, 7, True): 1, (8, 29_997, 4, False): 1})
    assert neardup.near_duplicates(empty(awkward)).count() == 0


def test_estimates():
    rng = np.random.default_rng(0)
    for n, m, both in ((200, 200, 180), (1000, 900, 500), (40, 40, 38)):
        h = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64) * np.uint64(2)
        a, b = h[:n], h[n - both :]
        r = neardup.registers(np.concatenate((a, b)), np.array([0, n, n + m]))
        assert abs(neardup.estimate(r[:1], r[1:], np.array([n]), np.array([m]))[0] - both / (n + m - both)) < neardup.SLACK


# Decontamination.
def test_decontamination_sql(spark, sf):
    same(queries.op2_decontamination(spark, sf), decontam.SQL, connect(sf))


def test_decontamination_of_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "one two"), (2, " ".join(f"w{i}" for i in range(100, 112))), (3, None), (4, "!!"), (2, "w5 w6"), (9, "ONE, two!"), (None, "here at all")], "item_id long, text string").withColumn("n", F.lit(1))
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(awkward, bench).collect())
    none = sha("")
    assert got == Counter({
        (1, 0, 0, 0, none, False): 1, (2, 0, 0, 0, none, False): 1, (3, 0, 0, 0, none, False): 1, (4, 30_000, 14, 1, sha("2"), True): 1, (5, 2, 2, 2, sha("1,9"), True): 2, (6, 2, 2, 2, sha("1,9"), True): 1,
        (None, 5, 3, 1, sha(""), True): 1, (7, 1, 0, 0, none, False): 1, (8, 30_001, 14, 1, sha("2"), True): 1,
    })
    assert decontam.decontaminate(empty(awkward), bench).count() == 0
    assert decontam.decontaminate(awkward, empty(bench)).where("contaminated").count() == 0


# Tokens and packing.
@pytest.fixture(scope="module")
def own_pieces():
    return tokens.Pieces(tokens.model_path())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab e.\n\t\r▁é漢😀<s>/\x00()1Tth")), max_size=25), max_size=4))
def test_tokens_are_the_librarys(own_pieces, texts):
    want = own_pieces.model.encode(texts) if texts else []
    assert [list(np.frombuffer(x, "<u2")) for x in own_pieces.encode_all(texts)] == want
    assert list(own_pieces.count_all(texts)) == [len(x) for x in want]


def test_token_counts(spark, awkward, docs, own_pieces):
    for df in (docs, awkward):
        texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        want = Counter((d, len(t.encode()), len(own_pieces.model.encode(t)), len(own_pieces.model.encode(t)) > 4096) for d, t in texts)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df).collect()) == want
    assert tokens.token_counts(empty(awkward)).count() == 0


def test_forgetting_changes_nothing(own_pieces, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 16_000)
    texts = [" ".join(f"xq{i}z{j}" for i in range(40)) for j in range(600)]
    assert list(own_pieces.count_all(texts)) == [len(x) for x in own_pieces.model.encode(texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=60))
def test_best_fit(sizes):
    rows, length = packing.best_fit(sizes, 37), 37
    assert sorted(i for r in rows for i in r) == list(range(len(sizes))) and all(sum(sizes[i] for i in r) <= length for r in rows)
    free, want = [], []  # by looking at all rows
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [x for x in free if x >= sizes[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[i])
        else:
            want.append(i)
            free.append(length - sizes[i])
    assert len(want) == len(rows)


def unpacked(rows):
    """Each document's tokens from packed rows, pieces in order."""
    parts = {}
    for r in rows:
        segments = packing.unpack(r.tokens, r.cu_seqlens)
        assert r.n_tokens == sum(map(len, segments)) <= 64 and r.n_segments == len(segments) == len(r.doc_ids)
        assert list(np.frombuffer(r.position_ids, "<u2")) == [i for s in segments for i in range(len(s))]
        for d, p, start, s in zip(r.doc_ids, r.pieces, r.starts, segments, strict=True):
            assert start == 64 * p
            parts.setdefault(d, {}).setdefault(p, []).append(s.tolist())
    return parts


def test_packing_is_lossless(spark, awkward, docs, own_pieces):
    rows = packing.packed_rows(docs, length=64).collect()
    parts = unpacked(rows)
    got = {d: [t for p in sorted(x) for t in x[p][0]] for d, x in parts.items()}
    want = {r.doc_id: own_pieces.model.encode(r.text) for r in docs.collect() if r.text}
    assert got == {d: t for d, t in want.items() if t}
    odd = unpacked(packing.packed_rows(awkward, length=64).collect())
    assert len(odd[5][0]) == 2 and sum(len(s) for p in odd[4].values() for s in p) == len(own_pieces.model.encode(LONG)) and -1 in odd and 1 not in odd
    assert packing.packed_rows(empty(awkward)).count() == 0


def test_packed_files(spark, docs, tmp_path):
    packing.write_packed(packing.packed_rows(docs, length=512), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n_tokens")).first()[0] == tokens.token_counts(docs).agg(F.sum("n_tokens")).first()[0]


# Mixing.
@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(alphabet="abcdef", min_size=1, max_size=3), st.floats(0.01, 50), min_size=1, max_size=12))
def test_schedule_keeps_to_the_weights(weights):
    units = mixing.to_units(weights, 200)
    slots = mixing.period(units)
    assert sorted(x for s in slots.values() for x in s) == list(range(200)) and all(len(slots[s]) == units[s] for s in units)
    owner = {x: s for s, xs in slots.items() for x in xs}
    done = Counter()
    for t in range(200):
        done[owner[t]] += 1
        assert all(abs(units[s] * (t + 1) / 200 - done[s]) < 1 for s in units)


def test_mixture(spark, docs, awkward):
    out = mixing.mix(docs, {f"src{i}": 1 + i % 3 for i in range(20)}).select("doc_id", "source", "slot", "place").collect()
    assert len(out) == docs.count() and len({(r.slot, r.place) for r in out}) == len(out)
    by = {}
    for r in out:
        by.setdefault(r.source, set()).add(r.slot)
    units = mixing.to_units({f"1src{i}": 1 + i % 3 for i in range(20)})
    table = mixing.period(units)
    for s, slots in by.items():
        own = table[f"1{s}"]
        assert sorted(slots) == [(j // len(own)) * sum(units.values()) + own[j % len(own)] for j in range(len(slots))]
    clash = awkward.withColumns({c: F.lit("y") for c in ("_name", "_number", "_hash", "_group", "_turn", "_at", "_slot", "_place")})
    odd = mixing.mix(clash)
    assert sorted(odd.columns) == sorted(clash.columns) and dict(odd.dtypes)["slot"] == "bigint" and dict(odd.dtypes)["number"] == "string"
    assert odd.count() == awkward.count() and odd.select("slot", "place").distinct().count() == awkward.count()
    assert mixing.mix(empty(awkward)).count() == 0
    ordered = mixing.mixed_in_order(clash)
    assert ordered.columns == clash.columns and {r.slot for r in ordered.collect()} == {"x"}


# Language.
def test_language(spark, docs, awkward, sf):
    out = queries.op5_language(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    tested = [r for r in out if r.held_out]
    assert len(out) == len(truth) and all(r.held_out == held(r.doc_id) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.93
    net = langid.fit(docs)
    odd = Counter((r.doc_id, r.lang_pred == "und", r.score == 0) for r in langid.identify(awkward, net).collect())
    assert odd == Counter({(1, True, True): 1, (2, True, True): 1, (3, True, True): 1, (4, False, False): 1, (5, False, False): 2, (6, False, False): 1, (None, False, False): 1, (7, True, True): 1, (8, False, False): 1})
    assert langid.identify(empty(awkward), net).count() == 0 and langid.fit(empty(docs)) is None
    assert {r.lang_pred for r in langid.identify(awkward, None).collect()} == {"und"}


def test_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    e, s, x = rng.normal(0, 0.2, (256, 3 * langid.HIDDEN)), rng.normal(0, 0.2, (3 * langid.HIDDEN, langid.HIDDEN)), rng.integers(97, 100, (5, 3))
    g = rng.normal(size=(5, langid.HIDDEN, 3))
    loss = lambda e, s: float((np.stack(langid._train_way(e, s, x)[0]) * g).sum())
    d_e, d_s = langid._back_way(s, x, langid._train_way(e, s, x)[1], g)
    for a, d, at in ((e, d_e, (98, 3)), (e, d_e, (97, 30)), (s, d_s, (2, 5)), (s, d_s, (30, 1))):
        up, down = a.copy(), a.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        want = (loss(up, s) - loss(down, s)) / 2e-5 if a is e else (loss(e, up) - loss(e, down)) / 2e-5
        assert d[at] == pytest.approx(want, rel=2e-3, abs=1e-5)


def test_positions_are_labelled():
    net = langid.train([b"aaaa bbb aaa " * 9, b"xyx yy xxx zz " * 9], ["a", "x"])
    p, labels = langid.probabilities(net, [b"aaab bba " * 60, b"", b"xxyz " * 3], labels=True)
    assert [len(x) for x in labels] == [540, 0, 15] and p[0, 0] > 0.9 and p[2, 1] > 0.9 and labels[0].mean() < 0.1


# Quality.
def test_quality(spark, sf, awkward):
    out = {r.doc_id: r for r in queries.op1_quality(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    tested = [d for d in truth if d in out and out[d].held_out]
    assert np.mean([out[d].predicted == truth[d] for d in tested]) > 0.93
    w = quality.fit(awkward.drop("predicted", "score", "held_out"), spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (7, 3, 0)], "doc_id long, quality int, toxic int"))
    odd = quality.score(awkward, w).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert len({r.score for r in odd if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score(empty(awkward), w).count() == 0


# URLs.
def test_rules_of_urls(spark):
    urls = {
        "http://a.example.com/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"), "HTTP://B.Example.COM/en/": ("b.example.com", "/en/", "com/en/", "block"), "x://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
        "x://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"), "https://org/es/": ("org", "/es/", "org/es/", "block"), "a://b.org/fr://c/es/": ("b.org", "/fr://c/es/", None, None), "http://com": ("com", "", None, None),
        "mailto:x": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "x://h#/en/": ("h", "", None, None), "://h.com/en/?": ("h.com", "/en/", "com/en/", "block"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "features", "label", "h", "suffix", "n")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    for i, (h, p, rule, verdict) in enumerate(urls.values()):
        assert got[i][:3] == (h, p, rule) and (got[i][3] == verdict if rule else got[i][3] in ("allow", "block"))
    assert urlfilter.judge(empty(pages)).count() == 0
    one = urlfilter.judge(pages.where("page_id IN (1, 7)")).collect()
    assert {r.verdict for r in one} == {"block"}


def test_every_rule_has_its_word(spark):
    """The contract's list, each rule met by a URL of its own."""
    words = {"http://a.com/en/x": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://b.net/de/1": ("net/de/", "allow"), "http://c.example.net/de/7": ("net/de/", "allow"), "http://c.example.net/de/8": ("example.net/de/8", "block"), "http://d.org/es/": ("org/es/", "block")}
    pages = spark.createDataFrame(list(enumerate(words)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert [got[i] for i in range(len(words))] == list(words.values())


def test_trees_learn_from_rules(spark, sf):
    out = queries.op3_url_filter(spark, "/root/testdata/sf0.01").collect()
    ruled = [r for r in out if r.rule]
    assert len(out) == 250 and np.mean([(r.method_score >= 0.5) == (r.verdict == "block") for r in ruled]) > 0.8


# HTML.
PAGE = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><div class='site-header'><a>Home</a></div><div id=wrap><div class='story main-column'>{0}<aside>side</aside><div class='share'>tweet</div></div><ul class=menu><li>one<li>two</ul></div><div id='comments'><article class='comment'><p>me too</p></article></div><form><p>mail</p></form></body></html>"


def test_wrapper_of_a_host():
    pages = [PAGE.format(f"<h2>Title {i}</h2><p>Text &amp; more {i * 7} of page {i}<p>Second   <b>bold</b>\n{i}") + "" for i in range(6)]
    w = html.induce(pages)
    assert w["path"][-1] == "div.story.main-column"
    assert html.extract(pages[3], w) == "Title 3\n\nText & more 21 of page 3\n\nSecond bold 3"


def test_template_texts_go_but_repeated_paragraphs_stay():
    body = "<article><p class=more>Read more in our archive today</p><p>{0}</p><p>shared line</p></article>"
    pages = [f"<body>{body.format('own words ' * 12 + str(i))}</body>".replace("shared line", "shared line" if i % 2 else f"line {i}") for i in range(8)]
    w = html.induce(pages)
    out = html.extract(pages[1], w)
    assert "archive" not in out and out.endswith("shared line")


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<br>b<p>c", "a b\n\nc"), ("<article><h1> x\n y </h1><nav>n</nav><p>&lt;z&gt; &eacute;&#x41;</article>", "x y\n\n<z> éA"), ("<p title='a>b'>q</p><!-- <p>no</p> -->r", "q\n\nr"),
    ("<div><p>cut <b>off", "cut off"), ("<main><p>m</p></main><p>out</p>", "m"), ("<article class=comment>c</article><article>a</article>", "a"), ("<p>a<script>if (a<b) '</p>'", "a"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ("<form><article><p>in a form</p></article></form>", "in a form"), ("a < b <p>&am", "a < b\n\n&am"), ("<ul><li>x<ul><li>y</ul><li>z</ul>", "x\n\ny\n\nz"),
])
def test_pages(page, want):
    assert html.extract(page) == want


def test_main_text_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id] == (want, len(want))
    odd = spark.createDataFrame([(1, None, None, 1), (1, None, "<p>x", 1), (None, "u", "", 1), (2, "a://h/", "<p>" + LONG, 1)], "page_id long, url string, html string, wrapper int").withColumn("host", F.lit(1))
    assert sorted((r.n_chars, r.text == "x") for r in html.main_text(odd).collect()) == [(0, False), (0, False), (1, True), (len(LONG), False)]
    assert html.main_text(empty(odd)).count() == 0


# Neighbours.
def test_neighbours_recall(spark, sf):
    out = queries.op7_nearest(spark, sf).collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    hit = total = 0
    for q in (i for i in v if i % 50 == 0):
        want = sorted(((-cos(v[q], v[i]), i) for i in v if i != q))[:5]
        got = sorted([r for r in out if r.query_id == q], key=lambda r: r.rank)
        assert [r.rank for r in got] == [1, 2, 3, 4, 5] and all(abs(r.score - cos(v[q], v[r.vec_id])) < 1e-12 for r in got)
        hit += len({i for _, i in want} & {r.vec_id for r in got})
        total += 5
    assert hit / total >= 0.9


def test_neighbours_over_shards_and_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(100, [0.0, 1.0]), (101, [0.0, 0.0]), (102, None), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]), (106, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0]), (107, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("shard", "rank", "dim", "score")})
    got = ann.nearest(df, df.where("vec_id IN (0, 3, 100, 106, 101)"), 5, shard=2).orderBy("query_id", "rank").collect()
    by = {q: [r.vec_id for r in got if r.query_id == q] for q in (0, 3, 100, 106, 101)}
    assert by == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 100: [0, 1, 2, 3, 4], 106: [], 101: []}
    assert ann.nearest(empty(df), df, 5).count() == 0 and ann.nearest(df, empty(df), 5).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    unit = ann._unit(rng.normal(size=(3000, 48)))
    levels = np.sort(np.minimum(-np.log(rng.random(3000)) / np.log(ann.M), 12).astype(int))[::-1]
    layers = ann.build(unit, levels)
    q = ann._unit(rng.normal(size=(100, 48)))
    found, _ = ann.walk(unit, layers[0], q, ann.descend(unit, layers[1:], q), ann.SEARCH)
    exact = np.argsort(-(q @ unit.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b[:5])) / 5 for a, b in zip(exact, found, strict=True)]) > 0.9
