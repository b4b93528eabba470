"""Corpus operators do the whole job on rows that the test tables do not hold."""

import hashlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from eventlens.llm import decontam, html, langid, mixing, queries


def words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


# HTML: names are evidence, not the verdict.
@pytest.mark.parametrize("tag", ["article class='post has-comments'", "article class=long-form", "div class='content with-sidebar'", "div id=page-with-ads"])
def test_names_do_not_drop_the_main_text(tag):
    name = tag.split()[0]
    pages = [f"<body><div class=sidebar>side {i}</div><{tag}><h1>Title {i}</h1><p>{words(i, 40)}</p></{name}><div class=comments>me too {i}</div></body>" for i in range(6)]
    want = [f"Title {i}\n\n{words(i, 40)}" for i in range(6)]
    w = html.induce(pages)
    assert [html.extract(p, w) for p in pages] == want
    assert [html.extract(p) for p in pages] == want  # pages alone on their host


def test_kinds_of_named_elements_are_taken_together():
    pages = ["<body>" + "".join(f"<div class='post has-comments'><p>{words(f'{i}y{k}', 20)}</p></div>" for k in range(5)) + f"<div class=footer>f{i}</div></body>" for i in range(4)]
    assert html.extract(pages[1], html.induce(pages)) == "\n\n".join(words(f"1y{k}", 20) for k in range(5))


def test_long_comments_of_a_few_pages_stay_out():
    pages = [f"<body><div class=story><p>{words(i, 40)}</p></div><div class=comments><p>{words(f'c{i}', 400 if i == 0 else 3)}</p></div></body>" for i in range(6)]
    assert html.extract(pages[0], html.induce(pages)) == words(0, 40)


def test_a_named_article_in_a_form():
    assert html.extract("<form><article class='post has-comments'><p>in a form</p></article></form>") == "in a form"


@pytest.mark.parametrize("page", [
    "<article><h1>Title {0}</h1><div class=content><p>{1}</p></div></article>", "<div class=page><h1>Title {0}</h1><div class=content><p>{1}</p></div></div>",
    "<article><h1>Title {0}</h1><section class=intro><p>{2}</p></section><section class=body><p>{1}</p></section></article>", "<main><h1>News</h1><h2>Title {0}</h2><div class=content><p>{1}</p></div></main>",
])
@pytest.mark.parametrize("n", [2, 6])
def test_the_wrapper_holds_all_slots(page, n):
    pages = [f"<body><div class=top>Site name</div>{page.format(i, words(i, 65), words(f'i{i}', 35))}<footer>f</footer></body>" for i in range(n)]
    w = html.induce(pages)
    for i, p in enumerate(pages):
        parts = ["News"] * ("News" in page) + [f"Title {i}"] + [words(f"i{i}", 35)] * ("intro" in page) + [words(i, 65)]
        assert html.extract(p, w) == "\n\n".join(parts)


def test_layouts_of_a_host_have_their_own_wrappers():
    story = [f"<body><div class=top>Hello {i}</div><div class=story><h1>Title {i}</h1><p>{words(i, 40)}</p></div></body>" for i in range(4)]
    shop = [f"<body><table class=goods><tr><td class=name>Thing {i}</td><td>{words(f's{i}', 30)}</td></tr></table></body>" for i in range(4)]
    w = html.induce(story + shop)
    assert len(w["more"]) == 1
    assert [html.extract(p, w) for p in shop] == [f"Thing {i}\n\n{words(f's{i}', 30)}" for i in range(4)]
    assert all(f"Title {i}\n\n{words(i, 40)}" in html.extract(p, w) for i, p in enumerate(story))


# Mixing: exact weights.
def deviation(order, weights):
    """The largest distance in blocks of any source from its target, in any prefix until a source runs out."""
    total, done, left, worst = sum(weights.values()), Counter(), Counter(order), Fraction(0)
    for t, s in enumerate(order, 1):
        done[s] += 1
        worst = max(worst, *(abs(w * t / total - done[x]) for x, w in weights.items()))
        if done[s] == left[s]:
            return worst
    return worst


@pytest.mark.parametrize("weights, n", [
    ({s: Fraction(1) for s in "abc"}, 3000), ({"a": Fraction("0.123457"), "b": Fraction("0.3"), "c": Fraction("0.576543")}, 2000), ({f"s{i:03d}": Fraction(1) for i in range(600)}, 5),
    ({"x": Fraction("0.9")} | {f"s{i:03d}": Fraction("0.1") / 499 for i in range(499)}, 5),
])
def test_schedules_keep_to_the_exact_weights(weights, n):
    units = mixing.to_units(weights)
    assert {s: Fraction(u, sum(units.values())) for s, u in units.items()} == {s: w / sum(weights.values()) for s, w in weights.items()}
    blocks = {s: max(1, int(n * w * len(weights) / sum(weights.values()))) for s, w in weights.items()}
    slots = mixing.period(units, blocks)
    assert sorted(x for xs in slots.values() for x in xs) == list(range(sum(blocks.values())))
    assert deviation([s for _, s in sorted((x, s) for s, xs in slots.items() for x in xs)], weights) < 1


def test_weights_as_written():
    assert mixing.to_units({"a": 0.1, "b": 0.2, "c": 0.7}) == {"a": 1, "b": 2, "c": 7} and mixing.to_units({"a": 3, "b": 3}) == {"a": 1, "b": 1}


@pytest.mark.parametrize("weights", [None, {"0": 1 / 7, "1": 0.2, "2": 0.657143}])
def test_mixture_to_exact_weights(spark, weights):
    docs = spark.range(4500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    order = [r.source for r in mixing.mix(docs, weights, block=1).orderBy("slot", "place").collect()]
    assert len(order) == 4500
    assert deviation(order, {s: Fraction(str((weights or {}).get(s, 1))) for s in "012"}) < 1


@pytest.mark.parametrize("n", [1500, 12000])
def test_more_sources_than_a_thousand(spark, n):
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % n).cast("string").alias("source"))
    out = mixing.mix(docs, block=1)
    assert out.count() == 2 * n and out.select("slot").distinct().count() == 2 * n and out.where(f"slot < {n}").select("source").distinct().count() == n


def test_mixing_query_has_unequal_weights(spark, sf):
    sf = "/root/testdata/sf0.01"
    out = queries.op4_mixing(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    weights = {f"src{i}": Fraction(1 + i % 3) for i in range(20)}
    assert {r.source for r in out} == set(weights)
    order = [s for _, s in sorted({(r.slot, r.source) for r in out})]
    assert len(set(r.slot for r in out)) == len(order) and deviation(order, weights) < 1


# Language.
def test_rare_languages_are_learnt(spark):
    ids = F.col("id")
    docs = spark.range(1000).select(ids.alias("doc_id"), F.concat(F.lit("some words of text number "), ids.cast("string")).alias("text"), F.when(ids >= 990, "xx").otherwise("en").alias("lang"))
    assert langid.fit(docs, sample=8).langs == ["en", "xx"]


# Decontamination.
def test_item_ids_with_commas(spark):
    run = words(1, 12)
    docs = spark.createDataFrame([(1, f"x {run} y"), (2, "one two"), (3, "a one two b"), (4, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([("a,b", run), ("c", run), ("d", "One, two!"), ("e", "one two b")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontam.decontaminate(docs, bench).collect()}
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    assert got == {1: (12, 2, sha("a,b,c")), 2: (2, 1, sha("d")), 3: (3, 2, sha("d,e")), 4: (0, 0, sha(""))}
