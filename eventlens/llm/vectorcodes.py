"""Compact codes of vectors: a codebook for each part, with assignments read from memoised grid cells.

Components become whole numbers, and a vector is cut into parts. A part falls into a coarse grid cell, a box. For
each box that occurs, those codebook entries are remembered that can be nearest to some point of it: an entry is
dominated if its least distance to the box exceeds another entry's greatest one. Only the remembered entries of
its box are measured against a part, exactly. Rounds add up sums and counts for each entry in the tasks;
the driver holds only the codebooks, whose size the parameters fix.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, small

#: Units of a component of 1; parts of a vector; entries of a codebook; rounds.
UNITS, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Width of a cell is 2 to this; cells of a part position that a task remembers at once; cells and pairs that are measured at once.
SHIFT, REMEMBER, CELLS, PAIRS = 5, 1 << 16, 256, 1 << 17
#: Components up to this leave squared distances of a part within 64 bits (parts of up to 64 components); larger ones are measured in Python's integers.
SAFE = 1 << 27
LONGEST = (1 << 63) - 1


def borders(size: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector of that size begin, and its end: equal parts; the first ones are longer by one if they cannot be equal."""
    return np.cumsum([0, *(size // parts + (i < size % parts) for i in range(parts))]).tolist()


class Memo:
    """Finds the nearest entry of one codebook (entries, width) for many parts; remembers the candidates of grid cells."""

    def __init__(self, book: np.ndarray, shift: int = SHIFT, remember: int = REMEMBER):
        self.book, self.shift, self.most = book, shift, remember
        self.cells: dict[bytes, np.ndarray] = {}
        self.measured = 0

    def _candidates(self, corner: np.ndarray) -> list[np.ndarray]:
        """For each cell, given by its lowest corner, the entries that no other dominates across it, rising."""
        out = []
        for lo in range(0, len(corner), CELLS):
            low = corner[lo : lo + CELLS]
            high = low + (1 << self.shift) - 1
            least, most = (np.zeros((len(low), len(self.book)), self.book.dtype) for _ in range(2))
            for j in range(self.book.shape[1]):
                below, above = low[:, j, None] - self.book[:, j], self.book[:, j] - high[:, j, None]
                near = np.maximum(np.maximum(below, above), 0)
                far = np.maximum(-below, -above)
                least += near * near
                most += far * far
            fit = least <= most.min(axis=1)[:, None]
            out += [np.flatnonzero(x) for x in fit]
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, the lowest of equals, and its squared distance."""
        if not len(parts):
            return np.zeros(0, np.int64), np.zeros(0, parts.dtype)
        cell = parts >> self.shift
        if parts.dtype == object:
            keys = [repr(x.tolist()).encode() for x in cell]
        else:
            flat = np.ascontiguousarray(cell, dtype="<i8")
            keys = flat.view(f"V{flat.shape[1] * 8}").ravel().tolist() if flat.shape[1] else [b""] * len(flat)
        if len(self.cells) > self.most:
            self.cells.clear()
        new = {k: i for i, k in enumerate(keys) if k not in self.cells}
        at = np.fromiter(new.values(), np.int64, len(new))
        self.cells.update(zip(new, self._candidates(cell[at] << self.shift), strict=True))
        lists = [self.cells[k] for k in keys]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        self.measured += int(count.sum())
        begin = np.cumsum(count) - count
        code, error = np.empty(len(parts), np.int64), np.empty(len(parts), parts.dtype)
        lo = 0
        while lo < len(parts):
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + PAIRS)))
            who, entry = np.repeat(np.arange(lo, hi), count[lo:hi]), np.concatenate(lists[lo:hi])
            gap = parts[who] - self.book[entry]
            far = (gap * gap).sum(axis=1) if gap.shape[1] else np.zeros(len(who), parts.dtype)
            first = begin[lo:hi] - begin[lo]
            low = np.minimum.reduceat(far, first)
            # Candidates rise, so the first that is as near as the nearest is the lowest.
            hit = np.flatnonzero(far == np.repeat(low, count[lo:hi]))
            _, one = np.unique(who[hit], return_index=True)
            code[lo:hi], error[lo:hi] = entry[hit[one]], low
            lo = hi
        return code, error


def whole(values: list) -> np.ndarray:
    """Vectors in whole units: 64-bit integers, or Python's where a component is beyond SAFE."""
    scaled = np.floor(np.array(values, dtype=np.float64) * UNITS) if len(values) else np.zeros((0, 0))
    if np.abs(scaled).max(initial=0) <= SAFE:
        return scaled.astype(np.int64)
    # Twice as large a float could not be scaled: the product is taken in integers.
    exact = [[UNITS * n // d for n, d in (float(x).as_integer_ratio() for x in v)] for v in values]
    return np.array(exact, dtype=object).reshape(len(values), -1)


def _memos(books: list[np.ndarray]) -> dict:
    return {kind: [Memo(b.astype(kind)) for b in books] for kind in ("int64", "object")} if all(np.abs(b).max(initial=0) <= SAFE for b in books) else {"object": [Memo(b.astype(object)) for b in books]}


def _coded(values: list, memos: dict, edges: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in units, their codes and their errors, a column a part."""
    units = whole(values)
    kind = "int64" if units.dtype != object and "int64" in memos else "object"
    units = units.astype(kind)
    found = [m.nearest(units[:, a:b]) for m, a, b in zip(memos[kind], edges[:-1], edges[1:], strict=True)]
    return units, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _summed(books: list[np.ndarray], edges: list[int]):
    """(part, entry, place, total) of each batch; place -1 holds the count. Totals are decimal texts, as they may pass 64 bits."""

    def run(batches):
        memos = _memos(books)
        for pdf in batches:
            if not len(pdf):
                continue
            units, code, _ = _coded(list(pdf["vec"]), memos, edges)
            rows = []
            for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                order = np.argsort(code[:, p], kind="stable")
                entry, first, count = np.unique(code[order, p], return_index=True, return_counts=True)
                total = np.add.reduceat(units[order, a:b], first, axis=0) if b > a else units[order][first][:, :0]
                rows += [(p, e, -1, str(c)) for e, c in zip(entry.tolist(), count.tolist(), strict=True)]
                rows += [(p, e, j, str(x)) for e, t in zip(entry.tolist(), total.tolist(), strict=True) for j, x in enumerate(t)]
            yield pd.DataFrame(rows, columns=["part", "entry", "place", "total"])

    return run


def _final(books: list[np.ndarray], edges: list[int], vec: str):
    def run(batches):
        memos = _memos(books)
        for pdf in batches:
            if len(pdf):
                _, code, error = _coded(list(pdf[vec]), memos, edges)
                total = [min(sum(map(int, e)), LONGEST) for e in error]
                yield pdf.drop(columns=vec).assign(code=["".join(f"{c:02x}" for c in row) for row in code], error=total)

    return run


def train(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of vectors (vec_id, vec) of that size, a list of entries a part: `rounds` rounds from the vectors of the smallest vec_ids."""
    edges = borders(size, parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    start = whole([r.vec for r in first])
    books = [start[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for _ in range(rounds):
        sums = vectors.select("vec").mapInPandas(_summed(books, edges), "part int, entry int, place int, total string")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found = {(r.part, r.entry, r.place): int(r.total) for r in sums.collect()}  # a number a component of the codebooks
        new = []
        for p, book in enumerate(books):
            moved = [[found[p, e, j] // found[p, e, -1] for j in range(book.shape[1])] if (p, e, -1) in found else list(map(int, row)) for e, row in enumerate(book)]
            moved = np.array(moved, dtype=object).reshape(book.shape)
            new.append(moved.astype(np.int64) if np.abs(moved).max(initial=0) <= SAFE else moved)
        books = new
    return books


def digest(books: list[np.ndarray]) -> str:
    """Hex SHA-256 of all components in order of part, entry and place, as decimals between commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors (vec_id, embedding, other columns) that are valid, with code, error and codebooks_sha256.

    A code has the index of each part's nearest codebook entry, two hex digits each (`entries` is 256 at most); error is the sum of the squared
    distances, in units, and the largest 64-bit number where that is beyond it. Vectors that are null or hold null or non-finite components
    are left out; rows without vec_id are coded, and come last where codebooks begin; equal ones and repeated vec_ids are rows of their own.
    Vectors of each length have codebooks of their own (empty ones have empty parts); parts that cannot be equal differ by one component. With
    fewer vectors than entries there are as many entries as vectors. An empty table gives an empty result; other columns are kept, but code,
    error and codebooks_sha256 are written anew.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    made = ("code", "error", "codebooks_sha256", "embedding")
    (vec,) = free(vectors, "vec")
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = [c for c in vectors.columns if c.lower() not in made]
    kept = vectors.where(F.coalesce(ok, F.lit(False))).select(*plain, F.col("embedding").cast("array<double>").alias(vec))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in plain) + ", code string, error long"
    out = None
    for row in kept.groupBy(F.size(vec).alias("n")).count().orderBy("n").collect():  # a row a length
        own = kept.where(F.size(vec) == row.n)
        books = train(own.select("vec_id", F.col(vec).alias("vec")), row.n, parts, entries, rounds)
        coded = own.mapInPandas(_final(books, borders(row.n, parts), vec), schema).withColumn("codebooks_sha256", F.lit(digest(books)))
        out = coded if out is None else out.unionByName(coded)
    if out is None:
        return kept.drop(vec).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")}).where("false")
    return out


def with_label_error(coded: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: label_error is the error summed over equal labels, nulls together."""
    coded = coded.select("vec_id", "label", "code", "error", "codebooks_sha256")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same_label")
    both = coded.join(small(sums), coded["label"].eqNullSafe(F.col("same_label")))
    return both.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the query: every part is measured against every entry."""
    head = """
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT k.r, p, k.v[p * len(k.v) // 4 + 1:(p + 1) * len(k.v) // 4] AS x FROM k, range(4) AS g(p)),
c0 AS (SELECT p, e, x FROM s JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 256) USING (r))"""
    near = "SELECT r, p, min(struct_pack(d := list_sum(list_transform(list_zip(s.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.e)) AS b FROM s JOIN c{0} AS c USING (p) GROUP BY r, p"
    out = [head]
    for i in range(rounds):
        out.append(f"""a{i} AS ({near.format(i)}),
u{i} AS (SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT p, b.e AS e, j, ((sum(x[j]) - (sum(x[j]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM a{i} JOIN s USING (r, p), range(1, len(x) + 1) AS h(j) GROUP BY p, b.e, j) GROUP BY p, e),
c{i + 1} AS (SELECT p, e, coalesce(u{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN u{i} USING (p, e))""")
    last = f"""f AS ({near.format(rounds)}),
o AS (SELECT r, string_agg(lower(printf('%02x', b.e)), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h"""
    return ",\n".join([*out, last])


SQL = _sql()
