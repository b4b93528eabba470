"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node, which keeps as many of its smallest ids as an answer can need. Nodes are dealt to
shards of bounded size by a hash. A shard's graph is built layer by layer from the top, in batches: all nodes
of a batch walk the graph together (numpy on whole batches, in double precision), choose diverse neighbours,
and are linked both ways. It is stored as flat neighbour arrays, one row a shard. Blocks of queries walk every
shard's graph; all nodes they reach are measured on the original vectors, and the shards' answers are merged.
Where all nodes that a walk keeps are as near as its k-th answer, or they are too few or hold too few ids, more
nodes may tie: such a query is measured against its shard's nodes one by one, so ties go to the smaller id
whatever their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Vectors of a shard, about; components of a block of queries, about; queries that walk together.
SHARD, BLOCK, TOGETHER = 8192, 1 << 19, 1024
#: Cosines that differ by less may be equal but for rounding.
TIE = 1e-12
#: Neighbours of a node on upper layers and on the lowest; nodes kept while building and, at least, while searching.
M, M0, BUILD, SEARCH = 12, 24, 48, 96
#: Share of the nearest nodes that a finished graph must find; nodes that it is measured on.
RECALL, PROBES = 0.97, 96
BATCH, SALT = 512, 64


def walk(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `keep` best nodes found from its entry node, best first: numbers (-1: none) and cosines.

    All queries advance together: each expands its best node that is not expanded, until it has none.
    """
    q, width = len(queries), links.shape[1]
    ids, sims, done = np.full((q, keep), -1, np.int32), np.full((q, keep), -2.0), np.zeros((q, keep), bool)
    seen = np.zeros((q, len(links)), bool)
    rows = np.arange(q)
    ids[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", queries, unit[entry])
    seen[rows, entry] = True
    active = rows
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), -3.0, sims[active])
        best = open_.argmax(axis=1)
        some = open_[np.arange(len(active)), best] > -3
        active, best = active[some], best[some]
        if not len(active):
            break
        done[active, best] = True
        near = links[ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        found = np.full((len(active), width), -2.0)
        found[r, c] = np.einsum("nd,nd->n", unit[near[r, c]], queries[active[r]])
        all_sims = np.concatenate((sims[active], found), axis=1)
        all_ids = np.concatenate((ids[active], np.where(fresh, near, -1)), axis=1)
        all_done = np.concatenate((done[active], np.zeros_like(fresh)), axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :keep]
        ids[active], sims[active], done[active] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_sims, all_done))
    return ids, sims


def choose(unit: np.ndarray, nodes: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """For each node up to `most` of its candidates (-1: none): those nearer to it than to any chosen before, then the nearest others."""
    n, c = cand.shape
    out = np.full((n, most), -1, np.int32)
    for lo in range(0, n, 256):
        own, part = nodes[lo : lo + 256], cand[lo : lo + 256]
        vec = unit[part]
        sim = np.where(part >= 0, np.einsum("ncd,nd->nc", vec, unit[own]), -2.0)
        order = np.argsort(-sim, axis=1, kind="stable")
        part, sim, vec = np.take_along_axis(part, order, 1), np.take_along_axis(sim, order, 1), np.take_along_axis(vec, order[:, :, None], 1)
        twice = np.zeros(part.shape, bool)
        for k in range(1, c):
            twice[:, k] = ((part[:, :k] == part[:, k : k + 1]) & (part[:, k : k + 1] >= 0)).any(axis=1)
        good = (part >= 0) & (part != own[:, None]) & ~twice
        between = vec @ vec.transpose(0, 2, 1)
        taken, count = np.zeros(part.shape, bool), np.zeros(len(part), int)
        for k in range(c):
            clash = np.where(taken, between[:, k], -3.0).max(axis=1)
            take = good[:, k] & (clash < sim[:, k]) & (count < most)
            taken[:, k] = take
            count += take
        rank = np.where(taken, 0, np.where(good, 1, 2))
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        picked = np.where(np.take_along_axis(rank, first, 1) < 2, np.take_along_axis(part, first, 1), -1)
        out[lo : lo + 256, : picked.shape[1]] = picked
    return out


def _link_back(unit: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Adds the reverse of the links of the new nodes; a node with too many chooses again."""
    width = links.shape[1]
    src = np.repeat(new, width)
    dst = links[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    more = np.full((len(nodes), int(count.max(initial=0))), -1, np.int32)
    more[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
    for lo in range(0, len(nodes), 1024):
        own, add = nodes[lo : lo + 1024], more[lo : lo + 1024]
        add = add[:, : max(1, int((add >= 0).sum(axis=1).max(initial=0)))]
        links[own] = choose(unit, own, np.concatenate((links[own], add), axis=1), width)


def build(unit: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays from the lowest layer up; nodes must come by falling level, so layer l has the first nodes."""
    top = int(levels[0]) if len(levels) else 0
    layers: list[np.ndarray] = []
    for level in range(top, -1, -1):
        n, width = int((levels >= level).sum()), M if level else M0
        links = np.full((n, width), -1, np.int32)
        start = min(n, 64)
        all_of = np.tile(np.arange(start, dtype=np.int32), (start, 1))
        links[:start] = choose(unit, np.arange(start), all_of, width)
        at = start
        while at < n:
            new = np.arange(at, min(n, at + min(BATCH, at)))
            entry = descend(unit, layers[::-1], unit[new])
            if (late := np.flatnonzero(entry >= at)).size:  # a node of the layer above that is not linked here yet: the nearest that is
                entry[late] = (unit[new[late]] @ unit[:at].T).argmax(axis=1)
            found, _ = walk(unit, links[:at], unit[new], entry, BUILD)
            near = unit[new] @ unit[new].T
            mates = np.argsort(-near, axis=1, kind="stable")[:, : min(len(new), width // 2 + 1)] + at
            links[new] = choose(unit, new, np.concatenate((found, mates.astype(np.int32)), axis=1), width)
            _link_back(unit, links, new)
            at = int(new[-1]) + 1
        layers.append(links)
    return layers[::-1]


def descend(unit: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Each query's entry node for the layer below the given ones (lowest first), by greedy steps from the top."""
    entry = np.zeros(len(queries), np.int64)
    for links in reversed(layers):
        entry = walk(unit, links, queries, entry, 4)[0][:, 0].astype(np.int64)
    return entry


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors by a power of two each, so that squares neither overflow nor vanish; cosines stay as they are."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = _scaled(vectors)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def width(unit: np.ndarray, layers: list[np.ndarray], k: int, recall: float = RECALL, probes: int = PROBES) -> int:
    """How many nodes a walk must keep: SEARCH, doubled until walks from evenly spread probes find that share of the probes' k nearest nodes."""
    n = len(unit)
    probe = np.unique(np.linspace(0, n - 1, min(n, probes)).astype(int))
    cos = unit[probe] @ unit.T
    cos[np.arange(len(probe)), probe] = -2.0
    k = min(k, n - 1)
    if k < 1:
        return SEARCH
    least = -np.partition(-cos, k - 1, axis=1)[:, k - 1] - TIE
    entry = descend(unit, layers[1:], unit[probe])
    keep = SEARCH
    while keep < n:
        found, _ = walk(unit, layers[0], unit[probe], entry, keep)
        near = np.where(found >= 0, np.take_along_axis(cos, np.maximum(found, 0), 1), -2.0) >= least[:, None]
        if np.minimum(near.sum(axis=1), k).sum() >= recall * k * len(probe):
            break
        keep *= 2
    return keep


def _index(key: tuple, pdf: pd.DataFrame, k: int, recall: float) -> pd.DataFrame:
    h = pdf["h"].to_numpy().view(np.uint64)
    level = np.minimum(-np.log((h >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54) / np.log(M), 12).astype(int)
    order = np.lexsort((h, -level))
    pdf, level = pdf.iloc[order], level[order]
    vectors = np.array(pdf["vec"].tolist(), dtype=np.float64)
    unit = _unit(vectors)
    layers = build(unit, level)
    members = list(pdf["ids"])
    ends = np.cumsum([len(x) for x in members])
    row = (key[0], key[1], vectors.tobytes(), np.concatenate(members).astype("<i8").tobytes(), ends.astype("<i8").tobytes(), [x.tobytes() for x in layers], width(unit, layers, k, recall))
    return pd.DataFrame([row], columns=["dim", "shard", "vectors", "ids", "ends", "layers", "keep"])


class Shard:
    """A shard's nodes: original vectors, ids of each, and the graph; answers queries."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, ends: np.ndarray, layers: list[np.ndarray], keep: int = SEARCH):
        self.ids, self.ends, self.layers, self.keep = ids, ends, layers, keep
        self.begins = np.concatenate(([0], ends[:-1]))
        self.vec, self.unit = _scaled(vectors), _unit(vectors)
        self.norm = np.sqrt((self.vec * self.vec).sum(axis=1))

    def _rank(self, row: np.ndarray, node: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(row, vec_id, score), the k best of each row's nodes: largest score, then smallest id, each id once and never the query's own."""
        score = np.empty(len(row))
        for lo in range(0, len(row), 1 << 16):
            r, n = row[lo : lo + (1 << 16)], node[lo : lo + (1 << 16)]
            q = queries[r]
            score[lo : lo + (1 << 16)] = (self.vec[n] * q).sum(axis=1) / (self.norm[n] * np.sqrt((q * q).sum(axis=1)))
        count = self.ends[node] - self.begins[node]
        at = np.repeat(self.begins[node], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row, vec_id, score = np.repeat(row, count), self.ids[at], np.repeat(score, count)
        other = vec_id != own[row]
        row, vec_id, score = row[other], vec_id[other], score[other]
        order = np.lexsort((-score, vec_id, row))
        row, vec_id, score = row[order], vec_id[order], score[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (vec_id[1:] != vec_id[:-1])
        row, vec_id, score = row[first], vec_id[first], score[first]
        order = np.lexsort((vec_id, -score, row))
        row, vec_id, score = row[order], vec_id[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[best], vec_id[best], score[best]

    def answers(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        queries, unit = _scaled(queries), _unit(queries)
        keep = min(self.keep, len(self.vec))
        found, sims = walk(self.unit, self.layers[0], unit, descend(self.unit, self.layers[1:], unit), keep)
        row, col = np.nonzero(found >= 0)
        out = self._rank(row, found[row, col], queries, own, k)
        count = np.bincount(out[0], minlength=len(own))
        worst = np.full(len(own), np.inf)
        np.minimum.at(worst, out[0], out[2])
        # Too few nodes reached, too few ids, or perhaps more nodes as near as the last answer.
        crowded = (keep < len(self.vec)) & ((found[:, -1] < 0) | (count < k) | (sims[:, -1] >= worst - TIE))
        parts = [tuple(x[~crowded[out[0]]] for x in out)]
        again = np.flatnonzero(crowded)
        for lo in range(0, len(again), 64):
            own_rows = again[lo : lo + 64]
            cos = unit[own_rows] @ self.unit.T
            # As many nodes as can be needed if each holds one other id: the query's own id is on at most as many nodes as it has rows here.
            need = min(len(self.vec), k + int((self.ids == own[own_rows][:, None]).sum(axis=1).max(initial=0)) + self._repeated)
            least = -np.partition(-cos, need - 1, axis=1)[:, need - 1 : need]
            r, n = np.nonzero(cos >= least - TIE)
            parts.append(self._rank(own_rows[r], n, queries, own, k))
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))

    @property
    def _repeated(self) -> int:
        """How many entries repeat an id that another node has too."""
        return len(self.ids) - len(np.unique(self.ids))


def _search(k: int):
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                layers = [np.frombuffer(x, np.int32).reshape(-1, M if i else M0) for i, x in enumerate(row.layers)]
                shard = Shard(np.frombuffer(row.vectors).reshape(-1, row.dim), np.frombuffer(row.ids, "<i8"), np.frombuffer(row.ends, "<i8"), layers, row.keep)
                queries, own = np.frombuffer(row.queries).reshape(-1, row.dim), np.array(row.query_ids)
                for lo in range(0, len(own), TOGETHER):
                    at, vec_id, score = shard.answers(queries[lo : lo + TOGETHER], own[lo : lo + TOGETHER], k)
                    if len(at):
                        yield pd.DataFrame({"query_id": own[lo : lo + TOGETHER][at], "vec_id": vec_id, "score": score})

    return run


def index(vectors: DataFrame, k: int, shard: int = SHARD, recall: float = RECALL) -> DataFrame:
    """One row a shard (dim, shard, vectors, ids, ends, layers, keep) of vectors (vec_id, vec) without invalid ones."""
    part = vectors.select("vec_id", "vec").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)))
    first = F.row_number().over(Window.partitionBy("vec", "salt").orderBy("vec_id"))
    few = part.distinct().withColumn("n", first).where(F.col("n") <= k + 1)
    nodes = few.groupBy("vec").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    nodes = materialize(nodes.withColumns({"h": F.xxhash64("vec"), "dim": F.size("vec")}), "ann-nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    dealt = nodes.join(F.broadcast(shards) if shards.limit(10_001).count() <= 10_000 else shards, "dim").withColumn("shard", F.pmod(F.xxhash64(F.col("h"), F.lit(1)), F.col("shards")).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(lambda key, pdf: _index(key, pdf, k, recall), "dim int, shard int, vectors binary, ids binary, ends binary, layers array<binary>, keep int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors found, by cosine in double precision.

    vectors and queries: (vec_id, embedding). A query is never its own answer. Ties go to the smaller vec_id;
    queries with fewer candidates get all. Null and zero vectors, those that hold null or non-finite
    components, and rows without vec_id take no part; vectors are compared only with those of their length. A
    repeated vec_id with several vectors counts with its best one. Empty tables give an empty result; other
    columns are ignored. A repeated query is answered once. Scores are the cosine in double precision; vectors are
    scaled by powers of two before, so very large and very small ones neither overflow nor vanish. Each shard's graph is measured on probes when it
    is built, and its walks are as wide as they must be to find `recall` of the nearest (spread vectors of many dimensions need wider ones).
    """

    def valid(df: DataFrame) -> DataFrame:
        ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
        return df.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))

    made = materialize(index(valid(vectors), k, shard, recall), "ann-index")
    asked = valid(queries)
    blocks = F.greatest(F.ceil(F.lit(asked.count()) * F.size("vec") / BLOCK), F.lit(1))
    flat = F.struct("vec_id", "vec")
    asked = asked.groupBy(F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec_id"), blocks).alias("block")).agg(F.sort_array(F.collect_list(flat)).alias("q"))

    def packed(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"dim": pdf["dim"], "query_ids": [[r["vec_id"] for r in q] for q in pdf["q"]], "queries": [np.array([r["vec"] for r in q], dtype=np.float64).tobytes() for q in pdf["q"]]})

    asked = asked.mapInPandas(packed, "dim int, query_ids array<long>, queries binary")
    # Every block meets every shard of its length: the stated queries against all rows, in blocks.
    met = made.join(asked.join(made.select("dim", "shard"), "dim"), ["dim", "shard"])
    met = met.repartition(F.col("shard"), F.xxhash64("query_ids"))
    found = met.mapInPandas(_search(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
