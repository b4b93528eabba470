"""Token ids packed into rows of fixed length by best-fit decreasing, and their binary output.

Texts are encoded, cut into pieces of at most `length` tokens (losslessly: piece numbers and starts are
kept), and dealt to shards of bounded size. In each shard the pieces go, longest first, into the row whose
free room fits best; a segment tree over free room finds it in logarithmic time. Full-length pieces are rows
of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, materialize, small, small_batches
from .tokens import model_path, pieces

LENGTH = 2048
#: Bytes of text that one shard should hold; a shard is packed in one task.
SHARD_BYTES = 2_000_000
#: Pieces of one document in a shard, at most; a longer document goes on in further shards.
RUN = 64

PACKED = (
    "shard string, row int, n_tokens int, n_segments int, tokens binary, doc_ids array<long>, pieces array<int>, starts array<long>,"
    " cu_seqlens array<int>, position_ids binary"
)


class Room:
    """Segment tree over free room 0..length: how many open rows have it; finds the least room that fits."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room >= need, the last such row; it is taken out."""
        i = need + self.size
        while not self.count[i]:
            while i & 1:  # a right child: go up until there is a right neighbour
                i >>= 1
                if i <= 1:
                    return None
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices into sizes (each 1..length), filled by best-fit decreasing; ties keep their order."""
    room, rows = Room(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = room.take(sizes[i])
        left, row = found or (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if left > sizes[i]:
            room.put(left - sizes[i], row)
    return rows


def _encode(where: str, length: int, kept: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, width = pieces(where), 2 * length
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in (*kept, "piece", "start", "ids")}
            for row, ids in zip(pdf[kept].itertuples(index=False), own.encode_all(list(pdf["text"])), strict=True):
                for k, lo in enumerate(range(0, len(ids), width)):
                    for c, v in zip(kept, row, strict=True):
                        out[c].append(v)
                    out["piece"].append(k)
                    out["start"].append(lo // 2)
                    out["ids"].append(ids[lo : lo + width])
            if out["ids"]:
                yield pd.DataFrame(out)

    return run


def _pack(length: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "doc_id", "h", "piece"], kind="stable", ignore_index=True)
        ids, docs, part, start = list(pdf["ids"]), pdf["doc_id"].to_numpy(), pdf["piece"].to_numpy(), pdf["start"].to_numpy()
        out = []
        for n, row in enumerate(best_fit([len(x) // 2 for x in ids], length)):
            sizes = [len(ids[i]) // 2 for i in row]
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            position = np.concatenate([np.arange(x, dtype="<u2") for x in sizes])
            out.append((key[0], n, int(ends[-1]), len(row), b"".join(ids[i] for i in row), docs[row], part[row], start[row], ends, position.tobytes()))
        return pd.DataFrame(out, columns=["shard", "row", "n_tokens", "n_segments", "tokens", "doc_ids", "pieces", "starts", "cu_seqlens", "position_ids"])

    return run


def packed_rows(docs: DataFrame, length: int = LENGTH, shard: Column | None = None, place: Column | None = None, path: str | None = None, shard_bytes: int | None = None) -> DataFrame:
    """Packed rows of the tokens of docs (doc_id, text), columns PACKED.

    tokens: the row's ids as little-endian uint16; position_ids: positions that begin anew with each segment,
    the same way; cu_seqlens: cumulative segment lengths from 0; doc_ids, pieces, starts: for each segment its
    document, the piece's number in it and the token it starts with. shard: a string column that says which
    documents are packed together (by default a hash of doc_id and text into shards of about SHARD_BYTES of text);
    place: their order in it (by default doc_id). Long documents are spread over shards by RUN pieces.

    A null or empty text has no tokens and no segment. Rows that repeat a doc_id are packed each; equal ones that are too much for a shard
    are spread. A null doc_id counts as -1. An empty table gives an empty result; other columns are ignored.
    """
    if not 1 <= length < 1 << 16:
        raise ValueError("length must be 1 to 65535")
    small_batches(docs.sparkSession)
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id")
    shard_bytes = shard_bytes or SHARD_BYTES
    if shard is None:
        text = F.col("text").cast("string")
        code = F.xxhash64(F.col("doc_id").cast("long"), text)
        each = docs.groupBy(code.alias("code")).agg(F.sum(F.octet_length(text).cast("long")).alias("bytes"))
        each = materialize(each, "packing-sizes")
        size = each.agg(F.sum("bytes")).first()[0] or 0
        # Rows of one id and text that are too much for a shard are dealt to shards by their places in the input.
        large = each.where(F.col("bytes") > shard_bytes).select("code")
        split = F.lit(None).cast("long")
        if not large.isEmpty():
            (mark,) = free(docs, "_large")
            docs = docs.join(small(large.withColumnRenamed("code", mark)), code == F.col(mark), "left")
            split = F.when(F.col(mark).isNotNull(), F.monotonically_increasing_id())
        shard = F.lpad(F.pmod(F.xxhash64(code, split), F.lit(1 + size // shard_bytes)).cast("string"), 6, "0")
    place = (place if place is not None else F.col("doc_id")).cast("long")
    rows = docs.select(doc_id, F.col("text").cast("string").alias("text"), shard.cast("string").alias("shard"), F.coalesce(place, F.lit(-1)).alias("place"), F.xxhash64("text").alias("h"))
    kept = ["doc_id", "shard", "place", "h"]
    cut = rows.mapInPandas(_encode(path or model_path(), length, kept), "doc_id long, shard string, place long, h long, piece int, start long, ids binary")
    # Further runs of a very long document go to shards of their own.
    cut = cut.withColumn("shard", F.when(F.col("piece") < RUN, F.col("shard")).otherwise(F.concat_ws("-", "shard", "doc_id", F.floor(F.col("piece") / RUN))))
    return cut.groupBy("shard").applyInPandas(_pack(length), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet, the id matrices as binary columns, through Spark's own writer."""
    packed.write.parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """The packed rows with hashes in place of their two binary columns."""
    return packed.withColumn("tokens_sha256", F.sha2("tokens", 256)).withColumn("positions_sha256", F.sha2("position_ids", 256)).drop("tokens", "position_ids")


def unpack(tokens: bytes, cu_seqlens: list[int]) -> list[np.ndarray]:
    """The segments of one packed row."""
    ids = np.frombuffer(tokens, dtype="<u2")
    return [ids[lo:hi] for lo, hi in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True)]
