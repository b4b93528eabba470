"""Near-duplicate detection by HyperMinHash registers, banding, and confirmation on full shingle sets.

Each document's set of distinct five-word shingles is reduced to 192 registers of 16 bits: the leading
zeros of the bucket's smallest hash and ten bits of mantissa after them. Documents with equal sets are one
class from the start. Six registers make a band; classes that share a band meet at the band's smallest
class (its hub), never all with all. Registers estimate each pair's Jaccard index, corrected for chance
collisions; pairs that could reach the threshold are confirmed on full sets made from the texts. Links
give components; bands that then still hold several components are compared across components, small ones
by a join, large ones in blocks inside tasks, so no link between different texts is lost to the hubs.

At a Jaccard index of exactly 0.85 a pair shares no band with probability 3e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small, small_batches
from .hashing import distinct_sets, mix, shingles

ROWS, BANDS, MANTISSA = 6, 32, 10
REGISTERS = ROWS * BANDS
#: A pair whose estimate is below the threshold by more than this is not confirmed: five standard errors at 192 registers.
SLACK = 0.13
#: Members of a bucket that are paired by a join; members and characters of a block in larger buckets.
SMALL, BLOCK_ROWS, BLOCK_CHARS = 16, 512, 2_000_000
#: A class of more rows than HOT_ROWS, and than this share of all rows, is broadcast when copies are told their class.
HOT_ROWS, HOT_CLASSES = 1000, 100_000
_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_BAND = _RNG.integers(1, 1 << 63, (1, 1, ROWS), dtype=np.uint64)


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) uint16 of non-empty sets: at has their beginnings in hashes and the end."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(at) - 1, REGISTERS), dtype=np.uint32)
    step = 1 << 13
    for i in range(len(at) - 1):
        if at[i + 1] - at[i] > step:  # a long text, in blocks
            low[i] = np.min([((h[x : min(x + step, at[i + 1]), None] ^ _XOR) * _MUL).min(axis=0) for x in range(at[i], at[i + 1], step)], axis=0)
    i = 0
    while i < len(at) - 1:
        if at[i + 1] - at[i] > step:
            i += 1
            continue
        j = i + 1
        while j < len(at) - 1 and at[j + 1] - at[i] <= step:
            j += 1
        part = (h[at[i] : at[j], None] ^ _XOR) * _MUL
        low[i:j] = np.minimum.reduceat(part, at[i:j] - at[i], axis=0)
        i = j
    exponent = np.frexp(low.astype(np.float64))[1]
    zeros = (32 - exponent).astype(np.uint64)
    mantissa = ((low.astype(np.uint64) << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64 bucket keys, different for different bands."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    mixed = (mix(r + np.uint64(1)) * _BAND).sum(axis=2, dtype=np.uint64)
    return mix(mixed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from register rows, corrected for registers that agree by chance."""
    same = (a == b).mean(axis=1)
    chance = 0.72 * n * m / (n + m) ** 2 / (1 << MANTISSA)
    return (same - chance) / (1 - chance)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), 512):
            part = pdf.iloc[lo : lo + 512]
            h, at = shingles(list(part["text"]))
            full = np.flatnonzero(np.diff(at))
            n, keys, regs, digest = np.zeros(len(part), np.int64), [None] * len(part), [None] * len(part), [None] * len(part)
            if len(full):
                r = registers(h, np.concatenate((at[full], at[-1:])))
                for i, row, key in zip(full, r, band_keys(r), strict=True):
                    own = np.unique(h[at[i] : at[i + 1]])
                    n[i], keys[i], regs[i], digest[i] = len(own), key, row.tobytes(), hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "h": part["h"].to_numpy(), "n_shingles": n, "digest": digest, "regs": regs, "bands": keys})


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, digest, regs, bands) for every row, h a hash of the text; the last three null for an empty set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).mapInPandas(_sketch, "doc_id long, h long, n_shingles long, digest binary, regs binary, bands array<long>")


def _screen(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint16).reshape(len(pdf), REGISTERS) for c in ("regs_a", "regs_b"))
                keep = estimate(a, b, pdf["n_a"].to_numpy(float), pdf["n_b"].to_numpy(float)) >= percent / 100 - SLACK
                if keep.any():
                    yield pdf.loc[keep, ["a", "b"]]

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, None
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                keep = []
                for a, text, other in zip(part["a"], part["text_a"], distinct_sets(list(part["text_b"])), strict=True):
                    if hub != (a, text):
                        hub, own = (a, text), next(distinct_sets([text]))
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * both >= percent * (len(own) + len(other) - both))
                if any(keep):
                    yield part.loc[keep, ["a", "b"]]

    return run


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold."""
    side = lambda x: nodes.select(F.col("doc_id").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = materialize(both.mapInPandas(_screen(percent), "a long, b long"), f"{name}-likely")
    ids = small(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct())
    texts = materialize(docs.join(ids, "doc_id", "left_semi").distinct(), f"{name}-texts")
    far = likely.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    far = far.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(far.mapInPandas(_confirm(percent), "a long, b long"), f"{name}-links")


def _compare_blocks(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "h"]).sort_values(["node", "h"], ignore_index=True)
        node, comp, block, n = pdf["node"].to_numpy(), pdf["comp"].to_numpy().copy(), pdf["block"].to_numpy(), pdf["n_shingles"].to_numpy(float)
        regs = np.frombuffer(b"".join(pdf["regs"]), dtype=np.uint16).reshape(len(pdf), REGISTERS)
        keys = band_keys(regs)
        band = int(np.argmax(keys[0] == key[0]))
        sets: dict[int, np.ndarray] = {}
        links = []
        for x in range(len(pdf)):
            y = np.arange(x + 1, len(pdf))
            y = y[(comp[y] != comp[x]) & ((block[y] != block[x]) | (key[1] == key[2]))]
            y = y[(100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])) & ~(keys[y, :band] == keys[x, :band]).any(axis=1)]
            if not len(y):
                continue
            likely = estimate(regs[y], regs[x], n[y], n[x])
            for z in y[np.argsort(-likely, kind="stable")][: int((likely >= percent / 100 - SLACK).sum())]:
                if comp[x] == comp[z]:
                    continue
                for i in (x, z):
                    if i not in sets:
                        sets[i] = next(distinct_sets([pdf["text"][i]]))
                both = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[z]) - both):
                    links.append((node[x], node[z]))
                    comp[comp == comp[z]] = comp[x]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _linked_in_blocks(rest: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between components in large buckets (bucket, node, comp, size).

    A bucket's members are dealt to blocks of bounded number and text size, and each pair of blocks is one
    group: pairs are estimated and confirmed in place, so only true links become rows. A pair is compared in
    the first band that it shares only, and not at all once its components are linked in the group. A doc_id with
    several texts has a member for each, with the registers of that text.
    """
    texts = docs.join(small(rest.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi").withColumn("h", F.xxhash64("text"))
    texts = materialize(texts.dropDuplicates(["doc_id", "h"]), "neardup-block-texts")
    full = rest.join(nodes.select(F.col("doc_id").alias("node"), "h", "n_shingles", "regs"), "node").join(texts.withColumnRenamed("doc_id", "node"), ["node", "h"])
    full = materialize(full, "neardup-block-rows")
    blocks = full.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)).cast("int").alias("blocks"))
    full = full.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "h"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = full.select("bucket", "node", "h", "comp", "n_shingles", "regs", "text", "block", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    # Pairs of blocks of one bucket are dealt to all tasks.
    return materialize(dealt.repartition("bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(_compare_blocks(percent), "a long, b long"), "neardup-block-links")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest doc_id reachable. Null and empty texts, and texts of white space, have an empty set and are
    linked with nothing. Rows that repeat a doc_id are one node. A null doc_id takes no part: its
    component_id is null and it is kept. An empty table gives an empty result; other columns are ignored.
    Percent below 72 would need narrower bands and is refused.
    """
    if percent < 72:
        raise ValueError("percent must be 72 or more")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = materialize(sketches(docs), "neardup-sketches")
    full = every.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    # Only texts that occur more than once need their class looked up; the few classes of very many are broadcast.
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = materialize(classes, "neardup-classes")
    hot = classes.where(F.col("n") > max(HOT_ROWS, every.count() // HOT_CLASSES)).select("digest", F.col("rep").alias("hot_rep"))  # HOT_CLASSES rows at most
    sets = full.select("doc_id", "h", "n_shingles", "digest").join(F.broadcast(hot), "digest", "left")
    rest = small(classes.join(F.broadcast(hot), "digest", "left_anti").select("digest", "rep"))
    cold = sets.where("hot_rep IS NULL").drop("hot_rep").join(rest, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    copies = materialize(cold.unionByName(sets.where("hot_rep IS NOT NULL").withColumnRenamed("hot_rep", "rep"), allowMissingColumns=True), "neardup-copies")
    # Of each class the row of smallest doc_id; a doc_id may be in several classes, with a text in each.
    reps = copies.where("doc_id = rep").groupBy("doc_id", "digest").agg(F.min("h").alias("h"))
    nodes = full.select("doc_id", "h", "n_shingles", "digest", "regs", "bands").join(reps, ["doc_id", "digest", "h"], "left_semi")
    nodes = materialize(nodes.dropDuplicates(["doc_id", "digest"]), "neardup-nodes")
    bands = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    hubs = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("bucket", "hub")
    met = materialize(bands.join(hubs, "bucket"), "neardup-met")
    stars = met.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    links = _linked(stars, nodes, known, percent, "neardup-1")
    # Classes that hold one doc_id (a repeated doc_id with several texts) are one node.
    twice = copies.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    twice = copies.select("doc_id", F.col("rep").alias("b")).join(twice.select("doc_id", "a"), "doc_id").where("a <> b").select("a", "b")
    links = materialize(links.unionByName(twice), "neardup-first")
    first = components(links, "neardup-1")
    # Bands in which members of several components meet: compare those, but not with the hub again.
    seen = met.where("node <> hub").join(first.withColumnRenamed("component", "comp"), "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = seen.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("bucket", "size")
    rest = materialize(seen.join(mixed, "bucket").select("bucket", "node", "comp", "size"), "neardup-rest")
    one, two = (rest.where(F.col("size") <= SMALL).select("bucket", F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in ("a", "b"))
    across = one.join(two, "bucket").where("a < b AND comp_a <> comp_b").select("a", "b").distinct()
    more = _linked(across, nodes, known, percent, "neardup-2").unionByName(_linked_in_blocks(rest.where(F.col("size") > SMALL), nodes, known, percent))
    last = components(links.unionByName(more), "neardup-all")
    rows = copies.select("doc_id", "n_shingles", "rep").unionByName(
        every.where("doc_id IS NULL OR digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    )
    out = rows.join(last.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
