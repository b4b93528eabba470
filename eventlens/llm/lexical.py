"""Ranked lexical search: dense blocked matrix products of item tiles and document tiles.

One pass over the texts keeps, for each document, the counts of those terms that any item has, and each batch's part
of the corpus statistics. Then tiles of documents meet tiles of items, each with a compact vocabulary of the terms
that both have: a float64 matrix of item weights times one of document impacts. Products and partial sums are whole
numbers below 2**53, so they are exact; a term whose weight alone would pass that bound is multiplied in 64-bit
integers. Every tile keeps all documents as good as an item's k-th best so far before ties are cut by doc_id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_batches, materialize, small_batches
from .decontam import words
from .hashing import LOWER

#: Item terms of a pass over the documents, about; items and documents of a tile.
TERMS, ITEMS, DOCS = 500_000, 256, 1024
#: Shares of an item's candidates that are ranked by themselves first.
SALT = 64
#: An impact is less than this; whole numbers below EXACT are exact in double precision.
IMPACT, EXACT = 1_000_000, 1 << 53
#: Bytes that end a term, once A-Z are lower-cased.
BREAK = np.zeros(256, dtype=bool)
BREAK[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def cut(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and where each text's begin (one more entry at the end)."""
    each = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b" ".join(each), dtype=np.uint8)]
    inside = ~BREAK[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    wide = offsets[-1] > np.iinfo(np.int32).max
    kind, size = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
    terms = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(size)), pa.py_buffer(data[inside])])
    at = np.concatenate(([0], np.cumsum([len(e) + 1 for e in each])))
    return terms.cast(pa.large_binary()), np.searchsorted(starts, at)


def _postings(vocabulary):
    """Rows (total, doc_id, n, ids, counts): a document's number of terms and its counts of vocabulary terms; after each batch a total:
    documents with terms as doc_id, their terms as n, and the vocabulary's document counts."""

    def run(batches):
        value_set = pa.array(vocabulary.value, pa.large_binary())
        size = max(len(value_set), 1)
        for pdf in batches:
            docs, every, df = 0, 0, np.zeros(size, np.int64)
            for part in held_batches(pdf, "text"):
                terms, at = cut(list(part["text"]))
                found = pc.fill_null(pc.index_in(terms, value_set=value_set), -1).to_numpy(zero_copy_only=False)
                n = np.diff(at)
                row = np.repeat(np.arange(len(part)), n)
                hit = found >= 0
                key, count = np.unique(row[hit] * size + found[hit], return_counts=True)
                ids, begin = key % size, np.searchsorted(key // size, np.arange(len(part) + 1))
                df += np.bincount(ids, minlength=size)
                docs, every = docs + int((n > 0).sum()), every + int(n.sum())
                some = np.flatnonzero(np.diff(begin) > 0)
                if len(some):
                    yield pd.DataFrame({
                        "total": False, "doc_id": part["doc_id"].iloc[some].array, "n": n[some],
                        "ids": [ids[begin[i] : begin[i + 1]].astype("<i4").tobytes() for i in some],
                        "counts": [count[begin[i] : begin[i + 1]].astype("<i8").tobytes() for i in some],
                    })
            has = np.flatnonzero(df)
            if docs:
                yield pd.DataFrame({"total": [True], "doc_id": [docs], "n": [every], "ids": [has.astype("<i4").tobytes()], "counts": [df[has].astype("<i8").tobytes()]})

    return run


def _each_count(batches):
    for pdf in batches:
        for ids, counts in zip(pdf["ids"], pdf["counts"], strict=True):
            yield pd.DataFrame({"id": np.frombuffer(ids, "<i4"), "df": np.frombuffer(counts, "<i8")})


def _numbers(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.int64)


def lengths(n: np.ndarray, docs: int, every: int) -> np.ndarray:
    """Each document's m from its number of terms: in 64-bit integers where they hold the product, else in Python's."""
    if int(n.max(initial=0)) * 75 * docs < 1 << 63:
        return 25 + (75 * n * docs) // every
    return _numbers([25 + (75 * int(x) * docs) // every for x in n])


def products(weights: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """The exact matrix product of item weights (items, terms) and impacts below IMPACT (terms, documents), by columns whose sums stay below EXACT."""
    out = np.zeros((weights.shape[0], impacts.shape[1]), np.int64)
    most = weights.max(axis=0, initial=0)
    lone = most >= EXACT // IMPACT
    for t in np.flatnonzero(lone):
        out += weights[:, t : t + 1] * impacts[t]
    rest = np.flatnonzero(~lone)
    block = np.zeros(len(rest), np.int64)
    held = at = 0
    for i, x in enumerate(most[rest].tolist()):
        held += x
        if held >= EXACT // IMPACT:
            at, held = at + 1, x
        block[i] = at
    for b in range(at + 1 if len(rest) else 0):
        part = rest[block == b]
        out += (weights[:, part].astype(np.float64) @ impacts[part].astype(np.float64)).astype(np.int64)
    return out


def best(item: np.ndarray, score: np.ndarray, no_id: np.ndarray, doc_id: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k first of each item: largest score, then smallest doc_id, rows without one last."""
    order = np.lexsort((doc_id, no_id, -score, item))
    item, score, no_id, doc_id = item[order], score[order], no_id[order], doc_id[order]
    first = np.arange(len(item)) - np.searchsorted(item, item) < k
    return item[first], score[first], no_id[first], doc_id[first]


class Tile:
    """Some items: their terms (rising ids) and, for each entry, item, place of its term and weight."""

    def __init__(self, lo: int, item: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int):
        self.lo, self.k = lo, k
        self.terms, self.column = np.unique(term, return_inverse=True)
        self.item, self.weight, self.items = item - lo, weight, int(item.max(initial=lo)) - lo + 1
        self.top = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        self.least = np.ones(self.items, np.int64)

    def meet(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, no_id: np.ndarray, doc_id: np.ndarray) -> None:
        """Ranks a tile of documents (no_id, doc_id), given as entries (row, term, impact), among the best so far."""
        place = np.searchsorted(self.terms, term)
        mine = place < len(self.terms)
        mine[mine] = self.terms[place[mine]] == term[mine]
        if not mine.any():
            return
        shared, column = np.unique(place[mine], return_inverse=True)
        rows, row = np.unique(row[mine], return_inverse=True)
        impacts = np.zeros((len(shared), len(rows)), np.int64)
        impacts[column, row] = impact[mine]
        at = np.searchsorted(shared, self.column)
        known = at < len(shared)
        known[known] = shared[at[known]] == self.column[known]
        weights = np.zeros((self.items, len(shared)), np.int64)
        weights[self.item[known], at[known]] = self.weight[known]
        score = products(weights, impacts)
        i, d = np.nonzero(score >= self.least[:, None])
        new = (i, score[i, d], no_id[rows[d]], doc_id[rows[d]])
        self.top = best(*(np.concatenate(x) for x in zip(self.top, new, strict=True)), self.k)
        count = np.bincount(self.top[0], minlength=self.items)
        full = np.flatnonzero(count >= self.k)
        self.least[full] = self.top[1][np.cumsum(count)[full] - 1]


def _search(job, k: int):
    """Each task's k best documents of every item: (item, score, doc_id)."""

    def run(batches):
        item, term, weight, docs, every = job.value
        edges = np.searchsorted(item, np.arange(0, int(item.max(initial=-1)) + 1 + ITEMS, ITEMS))
        tiles = [Tile(int(item[a]) // ITEMS * ITEMS, item[a:b], term[a:b], weight[a:b], k) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]
        for pdf in batches:
            for lo in range(0, len(pdf), DOCS):
                part = pdf.iloc[lo : lo + DOCS]
                ids = [np.frombuffer(x, "<i4") for x in part["ids"]]
                row = np.repeat(np.arange(len(part)), [len(x) for x in ids])
                tf = np.concatenate([np.frombuffer(x, "<i8") for x in part["counts"]])
                m = lengths(part["n"].to_numpy(np.int64), docs, every)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
                no_id = part["doc_id"].isna().to_numpy()
                doc_id = part["doc_id"].array.fillna(0).to_numpy(np.int64)
                for tile in tiles:
                    tile.meet(row, np.concatenate(ids), impact, no_id, doc_id)
        for tile in tiles:
            i, score, no_id, doc_id = tile.top
            if len(i):
                yield pd.DataFrame({"item": i + tile.lo, "score": score, "doc_id": pd.array(doc_id, "Int64").astype(object).where(~no_id, None) if no_id.any() else doc_id})

    return run


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _pass(docs: DataFrame, part: DataFrame, k: int) -> DataFrame | None:
    """The ranking of some items, given as (item_id, term, count): a bounded number of rows; None if nothing is found."""
    spark = docs.sparkSession
    rows = part.select("item_id", "term", "count").collect()
    item_ids = list(dict.fromkeys(r.item_id for r in rows))
    number = {x: i for i, x in enumerate(item_ids)}
    terms = sorted({r.term for r in rows})
    place = {t: i for i, t in enumerate(terms)}
    vocabulary = spark.sparkContext.broadcast([t.encode("utf-8", "surrogatepass") for t in terms])
    kept = materialize(docs.mapInPandas(_postings(vocabulary), "total boolean, doc_id long, n long, ids binary, counts binary"), "lexical-postings")
    totals = kept.where("total")
    n_docs, every = totals.agg(F.sum("doc_id"), F.sum("n")).first()
    if not n_docs:
        return None
    df = totals.select("ids", "counts").mapInPandas(_each_count, "id int, df long").groupBy("id").agg(F.sum("df").alias("df"))
    weights = {r.id: weight(n_docs, r.df) for r in df.collect()}  # a row a term of the pass
    entries = sorted((number[r.item_id], place[r.term], r["count"] * weights[place[r.term]]) for r in rows if place[r.term] in weights)
    item, term, value = (_numbers([e[i] for e in entries]) for i in range(3))
    job = spark.sparkContext.broadcast((item, term, value, n_docs, every))
    found = kept.where("NOT total").drop("total").mapInPandas(_search(job, k), "item long, score long, doc_id long")
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    share = F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).orderBy(*by))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*by))
    first = found.withColumn("rank", share).where(F.col("rank") <= k).withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(item_ids)), f"item long, item_id {part.schema['item_id'].dataType.simpleString()}")
    return first.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) the k documents (doc_id, text) of largest score above 0, ties by doc_id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A term weighs floor(1000 * ln((2N + 2) / (2df + 1)));
    a document of n terms has m = 25 + 75nN div L, and a term that it holds tf times gives weight * (10**9 tf div (1000 tf + 8m)) for each
    time that the item has it. N are the documents with terms, L all their terms, df the documents with the term.

    Null and empty texts have no terms: such documents do not count, such items have no rows. Each row of docs is a document by itself, also
    where it repeats another or has no doc_id (ranked after equal scores with one, as null). Repeated rows of items count once; several texts
    of one item_id, null too, are one item of all their terms. Empty tables give an empty result; other columns are ignored.

    Items go in passes of about `terms` different terms each, so what is broadcast has a bound; each pass reads the documents once.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    each = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    each = each.select("item_id", F.explode(words(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("count"))
    each = materialize(each, "lexical-items")
    passes = max(1, math.ceil(each.count() / terms))
    own = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(passes))
    out = None
    for p in range(passes):
        got = _pass(docs, each.where(own == p), k)
        out = out or got if got is None else got if out is None else out.unionByName(got)
    if out is None:
        return each.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM i GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
t AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
p AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l))) AS v FROM t JOIN w USING (term), s),
x AS (SELECT item_id, r, doc_id, sum(c * v)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL),
y AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 10
"""
