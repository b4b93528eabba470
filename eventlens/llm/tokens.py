"""Token counts and ids with a sentencepiece BPE model, most words by a whole-token shortcut.

The model joins neighbouring symbols only into pieces of its vocabulary. If no piece has a space mark after
another character, and none holds a line feed, then a text falls apart into pre-tokens that never merge
with each other: runs of spaces with the characters after them, and line feeds. `Pieces` proves both facts
for the vocabulary, and proves which pieces encode alone as themselves; such a pre-token is one token and is
looked up. Only other pre-tokens are merged by the library, once each per worker while they are remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: Pre-tokens that a worker remembers; beyond it, it forgets all but the proven ones and goes on.
REMEMBER = 400_000
#: Longer pre-tokens are merged each time, so that what is remembered stays small.
LONGEST = 64
#: In a line with runs of spaces: spaces with what follows them, what stands at its beginning.
PART = re.compile(" +[^ ]*|[^ ]+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Ids of texts, as little-endian uint16 bytes, and their numbers.

    Pre-tokens of a space and what follows it are known by what follows; all others by their full string
    after a line feed, which no word holds.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size, one = self.model.get_piece_size(), self.model.piece_to_id
        if size > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        plain = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        names = {i: self.model.id_to_piece(i) for i in plain}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in names.values()):
            raise ValueError("this vocabulary joins characters across spaces or lines")
        if self.model.encode("a b") != [one(MARK + "a"), one(MARK + "b")] or self.model.encode("\n") != [one(MARK), one("<0x0A>")]:
            raise ValueError("this model treats spaces or line feeds in another way")
        self.begins = np.zeros(size, dtype=bool)
        self.begins[[i for i, p in names.items() if p[0] == MARK]] = True
        words = {p[1:]: i for i, p in names.items() if p[0] == MARK and len(p) > 1 and MARK not in p[1:]}
        self.proven = {w: x for (w, i), x in zip(words.items(), self._words(list(words)), strict=True) if x == array("H", [i]).tobytes()}
        self.ids, self.counts = dict(self.proven), dict.fromkeys(self.proven, 1)

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words that follow one space each: merged together, and cut where a piece begins with the mark."""
        for lo in range(0, len(words), 64):
            part = words[lo : lo + 64]
            ids = np.array(self.model.encode(" ".join(part), num_threads=1), dtype=np.uint16)
            cut = np.append(np.flatnonzero(self.begins[ids]), len(ids)).tolist()
            raw = ids.tobytes()
            for a, b, _ in zip(cut[:-1], cut[1:], part, strict=True):
                yield raw[2 * a : 2 * b]

    def _others(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of other pre-tokens, each after a line feed, whose mark and line feed are then cut off."""
        for x in self.model.encode(parts, num_threads=1):
            yield array("H", x[2:]).tobytes()

    @staticmethod
    def split(text: str) -> list[str]:
        out: list[str] = []
        for n, line in enumerate(text.replace(MARK, " ").split("\n")):
            if n:
                out.append("\n\n")
            words = line.split(" ")
            if n and words[0]:
                words[0] = "\n" + words[0]
            elif n:
                words = words[1:]
            if "" in words:
                words = ["\n" + p if p[:2] == "  " or p[0] != " " or len(p) == 1 else p[1:] for p in PART.findall(line if n else " " + line)]
            out += words
        return out

    def _all(self, texts: list[str | None], table: dict, value: Callable, total: Callable) -> Iterator:
        for lo in range(0, len(texts), 128):
            split = [self.split(t) if t else [] for t in texts[lo : lo + 128]]
            found = [list(map(table.get, parts)) for parts in split]
            new = {p for parts, got in zip(split, found, strict=True) if None in got for p, x in zip(parts, got, strict=True) if x is None}
            words, others = [p for p in new if p[0] != "\n"], [p for p in new if p[0] == "\n"]
            own = dict(zip(words, map(value, self._words(words)), strict=True)) | dict(zip(others, map(value, self._others(others)), strict=True))
            for parts, got in zip(split, found, strict=True):
                yield total([own[p] if x is None else x for p, x in zip(parts, got, strict=True)] if None in got else got)
            if len(table) + len(own) > REMEMBER:
                table.clear()
                table.update((p, value(x)) for p, x in self.proven.items())
            table.update((p, x) for p, x in own.items() if len(p) <= LONGEST)

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """All ids of each text, as the library gives them, without begin or end tokens."""
        return self._all(texts, self.ids, bytes, b"".join)

    def count_all(self, texts: list[str | None]) -> Iterator[int]:
        return self._all(texts, self.counts, lambda x: len(x) // 2, sum)


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row of docs (doc_id, text).

    A null text counts as an empty one: no bytes, no tokens. Rows that repeat a doc_id are counted each;
    a null doc_id stays null; an empty table gives an empty result; other columns are ignored. path: the
    model's file, which every executor must have (by default the installed public one).
    """
    where = path or model_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(where)
        for pdf in batches:
            n = list(own.count_all(list(pdf.pop("text"))))
            if len(pdf):
                yield pdf.assign(n_tokens=np.array(n, dtype=np.int64))

    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = docs.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
