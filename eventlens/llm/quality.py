"""Text quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Features are single words and pairs of neighbouring words in two views: the lower-cased word, and its shape
(letters, capitals, digits, each other character as it is). All pairs of equal words are one feature. All are hashed into a fixed number of weights.
A text's value of a feature is its count divided by the root of the text's feature count; a score is a sparse
dot product, computed for a whole batch by gathering weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, small_batches
from .hashing import LOWER, mix, words
from .langid import _parts

#: Weights: 2**BITS hashed ones and a bias.
BITS = 18
#: Bound of the training sample, for each of the two labels.
SAMPLE = 2000
#: Bytes of the sample's features that the driver holds at a time.
HELD = 128 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 1.0, 3
#: Bytes to their classes.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 97


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of every feature occurrence, text by text, and where each text's begin (and the end)."""
    views = []
    for fold, salt in ((LOWER, 1), (SHAPE, 2)):
        h, at = words(texts, fold=fold)
        h = h + np.uint64(salt)
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
        pair = np.where(h[:-1] == h[1:], np.uint64(salt), pair)  # a word said twice is one feature, whatever the word
        inside = np.ones(len(pair), dtype=bool)
        inside[at[(at > 0) & (at < len(h))] - 1] = False  # a pair of two texts
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        views += [(mix(h), doc), (pair[inside], doc[:-1][inside] if len(doc) else doc)]
    doc = np.concatenate([d for _, d in views])
    index = (np.concatenate([x for x, _ in views]) >> np.uint64(64 - BITS)).astype(np.int64)
    return index[np.argsort(doc, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))


def train(examples: Iterable[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the bias last) from (feature numbers, values, label), one after the other; all zero without examples."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for idx, x, y in examples:
        i, x = np.append(idx, 1 << BITS), np.append(x, 1.0)
        w = weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
        z[i] += g - sigma * w
        n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def epochs(stored: DataFrame, most: int = HELD, seed: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The examples of a written table (doc_id, quality, h, idx, val) in EPOCHS random orders; at most about `most` bytes of them are held at a time."""
    keys = sorted(stored.select("h", "doc_id", "quality", (F.octet_length("idx") + F.octet_length("val")).alias("size")).collect())  # a row an example
    rng, total = np.random.default_rng(seed), sum(k.size for k in keys)
    held: dict[tuple, tuple] = {}

    def load(part: list) -> None:
        rows = stored if len(part) == len(keys) else stored.join(F.broadcast(stored.sparkSession.createDataFrame([(k.h, k.doc_id, k.quality) for k in part], "h long, doc_id long, quality int")), ["h", "doc_id", "quality"])
        held.clear()
        held.update({(r.h, r.doc_id, r.quality): (np.frombuffer(r.idx, "<u4").astype(np.int64), np.frombuffer(r.val, "<f4").astype(float), r.quality) for r in rows.toLocalIterator()})

    for _ in range(EPOCHS):
        order = [keys[e] for e in rng.permutation(len(keys))]
        lo = 0
        while lo < len(order):
            hi, size = lo + 1, order[lo].size
            while hi < len(order) and (total <= most or size + order[hi].size <= most):
                size += order[hi].size
                hi += 1
            if total > most or not held:
                load(order[lo:hi])
            yield from (held[k.h, k.doc_id, k.quality] for k in order[lo:hi])
            lo = hi


def _featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in _parts(pdf, 1_000_000):
            index, at = features(list(part["text"]))
            rows = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                i, c = np.unique(index[lo:hi], return_counts=True)
                rows.append((i.astype("<u4").tobytes(), (c / np.sqrt(max(hi - lo, 1))).astype("<f4").tobytes()))
            yield pd.DataFrame({"doc_id": part["doc_id"], "quality": part["quality"], "h": part["h"], "idx": [a for a, _ in rows], "val": [b for _, b in rows]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = HELD) -> np.ndarray:
    """Weights from labels.quality of documents that are not held out.

    A bounded sample is used: of each label the `sample` labelled ids of smallest hash. Each one's features
    are computed in tasks from its whole text, at most 2**BITS of them. An id that repeats in docs or labels
    counts once for each label, with the text of smallest hash. The features are written, and the driver reads them in portions of `held`
    bytes: longer texts need more portions, not more memory.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h"))
    picked = [known.where(F.col("quality") == y).distinct().orderBy("h", "doc_id").limit(sample) for y in (0, 1)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # two samples at most
    rows = rows.groupBy("doc_id", "quality", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    made = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "h", "text").mapInPandas(_featurize, "doc_id long, quality int, h long, idx binary, val binary")
    return train(epochs(materialize(made, "quality-features"), held))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Every text is read whole; a null text is scored as an empty one (by the bias alone). Rows that repeat a
    doc_id are scored each; a null doc_id is not held out; an empty table gives an empty result; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    raw = weights.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.frombuffer(raw, np.float32)
        for pdf in batches:
            for part in _parts(pdf, 1_000_000):
                index, at = features(list(part["text"]))
                total = np.concatenate(([0.0], np.cumsum(w[index], dtype=np.float64)))
                n = np.diff(at)
                z = (total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(n, 1)) + w[-1]
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": 1 / (1 + np.exp(-np.clip(z, -35, 35)))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
