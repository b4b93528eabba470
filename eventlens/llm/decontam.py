"""Benchmark decontamination by winnowing, in DataFrame operations only.

From a document's words every run of K words is hashed, and of each window of SPAN - K + 1 neighbouring
hashes the smallest is kept, so every run of SPAN words keeps at least one hash. A benchmark item's side
keeps all of its hashes. Fingerprints are joined as bare hashes first; only documents that share one are cut
into words again, and there each hit carries the words around it, which are extended to the runs of SPAN
words that hold the hit and compared with the items' runs word for word. So every shared run of SPAN words is
found. An item shorter than SPAN words is one run; it is looked up at its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

SPAN, K = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that are in no word.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Of ASCII texts lower() changes A-Z only, and is much faster.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAK), "")


def _grams(hashes: Column, n: int) -> Column:
    """Hash of each run of n neighbours; hashes must be a plain column, as each of its values is read n times."""
    last = F.size(hashes) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column) -> Column:
    """The smallest of each window of neighbouring hashes; grams must be a plain column."""
    width = SPAN - K + 1
    last = F.size(grams) - width
    low = F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(grams, i + j) for j in range(width)]))
    return F.when(last >= 0, low).otherwise(F.array().cast("array<bigint>"))


def _winnow(df: DataFrame, grams: str, kept: str) -> DataFrame:
    """Adds the places of grams that are the smallest of some window: those that equal the largest of their windows' minima."""
    g, m, width = F.col(grams), F.col("minima"), SPAN - K + 1
    df = df.withColumn("minima", _minima(g))
    is_low = lambda p: F.get(g, p) == F.greatest(*[F.get(m, p - j) for j in range(width)])
    places = F.when(F.size(m) > 0, F.filter(F.sequence(F.lit(0), F.size(g) - 1), is_low)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(kept, places).drop("minima")


def _around(ws: Column, lo: Column, n: int) -> Column:
    """The words from lo on, n at most, beginning at the text's first word if lo is negative."""
    return F.slice(ws, F.greatest(lo, F.lit(0)) + 1, F.lit(n) + F.least(lo, F.lit(0)))


def _runs(benchmark: DataFrame) -> DataFrame:
    """(n, run, item): each item's runs of words, joined by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(SPAN))
    starts = F.sequence(F.lit(1), F.size("ws") - n + 1)
    each = items.select(F.coalesce("item", F.lit("")).alias("item"), n.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("ws"), i, n), " "))).alias("run"))
    return each.distinct()


KEY = ["doc_id", "text_hash"]


def _hashed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text_hash, ws, hs): words and their hashes."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))
    return rows.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))


def _candidates(docs: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """Keys of documents that share a kept hash with an item, or the hash of a run of one of the lengths."""
    rows = _hashed(docs).drop("ws").withColumn("grams", _grams(F.col("hs"), K))
    every = F.array_distinct(F.concat(_minima(F.col("grams")), *[_grams(F.col("hs"), n) for n in lengths]))
    return rows.select(*KEY, F.explode(every).alias("gram")).join(prints, "gram", "left_semi").select(*KEY).distinct()


def _hits(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(key..., at, n, set_id): occurrences of benchmark runs in documents; runs: (n, run, set_id)."""
    of_run = F.transform(F.split("run", " "), lambda w: F.xxhash64(w)).alias("hs")
    marks = {SPAN: K}  # the length of the hashed runs for each length of items
    marks |= {r.n: r.n for r in runs.where(F.col("n") < SPAN).select("n").distinct().collect()}  # at most SPAN - 1 numbers
    prints = {n: materialize(runs.where(F.col("n") == n).select(of_run).select(F.explode(_grams(F.col("hs"), k)).alias("gram")).distinct(), "decontam-prints") for n, k in marks.items()}
    all_prints = prints[SPAN]
    for n in marks:
        all_prints = all_prints if n == SPAN else all_prints.union(prints[n])
    near = small(materialize(_candidates(docs, small(all_prints), [n for n in marks if n < SPAN]), "decontam-near"))
    hash_ = F.xxhash64("text")
    docs = docs.join(near.select(F.col("doc_id").alias("id"), "text_hash"), docs["doc_id"].eqNullSafe(F.col("id")) & (hash_ == F.col("text_hash")), "left_semi")
    hashed = _hashed(docs)
    # Each kept hash with the words of all runs of SPAN words that hold it.
    kept = _winnow(hashed.withColumn("grams", _grams(F.col("hs"), K)), "grams", "kept")
    around = F.transform("kept", lambda p: F.struct(F.get("grams", p).alias("gram"), F.greatest(p - (SPAN - K), F.lit(0)).alias("lo"), _around(F.col("ws"), p - (SPAN - K), 2 * SPAN - K).alias("ws")))
    hit = kept.select(*KEY, F.explode(around).alias("x")).select(*KEY, "x.*").join(small(prints[SPAN]), "gram", "left_semi")
    spans = F.transform(F.sequence(F.lit(0), F.size("ws") - SPAN), lambda i: F.struct((F.col("lo") + i).alias("at"), F.array_join(F.slice(F.col("ws"), i + 1, SPAN), " ").alias("run")))
    found = hit.where(F.size("ws") >= SPAN).select(*KEY, F.explode(spans).alias("x")).select(*KEY, "x.at", F.lit(SPAN).alias("n"), "x.run").distinct()
    # Items shorter than SPAN words: for each length that occurs, every run of that length whose hash an item has.
    for n in (n for n in marks if n < SPAN):
        every = F.transform(_grams(F.col("hs"), n), lambda g, i: F.struct(g.alias("gram"), i.alias("at")))
        more = hashed.select(*KEY, "ws", F.explode(every).alias("x")).select(*KEY, "ws", "x.*").join(small(prints[n]), "gram", "left_semi")
        found = found.unionByName(more.select(*KEY, "at", F.lit(n).alias("n"), F.array_join(F.slice("ws", F.col("at") + 1, F.lit(n)), " ").alias("run")).distinct())
    return found.join(small(runs), ["n", "run"]).select(*KEY, "at", "n", "set_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text).

    n_hit counts the document's words inside any occurrence of any run of an item (item_id, text) of
    benchmark; n_items counts the items with such runs; items_sha256 is the hex SHA-256 of their ids, sorted
    as strings and joined by commas (of the empty string if there are none). Null and empty texts have no
    words and hit nothing; an item without words is never hit. Repeated items count once an item_id; a null
    item_id counts as an empty one. Rows that repeat a doc_id are judged each by its own text; a null doc_id
    is allowed. Empty tables are allowed on both sides; other columns are ignored.

    Runs that the same items share are one set of items, and documents with the same sets are resolved once,
    so a passage in many items or many documents is not multiplied out. An item_id may hold any characters,
    commas too; a set is as large as the number of items that share a run, as its digest needs all their ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = materialize(_runs(benchmark), "decontam-runs")
    sets = each.groupBy("n", "run").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    runs = materialize(sets.withColumn("set_id", F.xxhash64("ids")), "decontam-sets")
    own = runs.groupBy("set_id").agg(F.first("ids").alias("ids"))
    hits = _hits(docs, runs.select("n", "run", "set_id"))
    span = F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi"))
    found = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("set_id")).alias("sets"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    cover = lambda acc, x: F.struct((acc["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], x["hi"]).alias("to"))
    found = found.select("doc_id", "text_hash", "sets", F.aggregate("spans", start, cover)["n"].alias("n_hit"))
    found = materialize(found, "decontam-found")
    kinds = found.select("sets").distinct()
    items = kinds.select("sets", F.explode("sets").alias("set_id")).join(own, "set_id").groupBy("sets").agg(F.collect_set("ids").alias("ids"))
    items = items.withColumn("ids", F.array_sort(F.array_distinct(F.flatten("ids"))))
    items = items.select("sets", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    found = found.join(items, "sets").drop("sets").withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["id"]) & (base["text_hash"] == found["hash"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
r AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS run
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
g AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS run
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM r) WHERE len(ws) >= n)),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM g JOIN r USING (n, run)),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)
"""
