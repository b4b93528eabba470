"""Language identification by a bidirectional gated recurrent network over bytes.

One recurrent layer reads a text's bytes forwards and one backwards; at every position both states give
probabilities of the languages, and a document's are their mean. Gates and states use the hard sigmoid and
the hard hyperbolic tangent, so a step is a few cheap array operations on thousands of stretches at once.
The network is trained in numpy by backpropagation through time on a bounded sample of labelled documents.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out, materialize, small, small_batches

#: Bound of the training sample, in documents; their texts are used whole.
SAMPLE = 3000
HIDDEN, STEPS, LANES, UPDATES, RATE = 12, 96, 192, 180, 0.014
#: A text is read in stretches of so many bytes, all of them, so many stretches at a time. Both states begin anew
#: in each stretch, of documents of any length: a position sees the bytes of its own stretch.
READ, WIDE = 256, 2048


@dataclass
class Network:
    langs: list[str]
    embed: tuple[np.ndarray, np.ndarray]  # of a byte, for each direction: (256, 3 * HIDDEN)
    state: tuple[np.ndarray, np.ndarray]  # (3 * HIDDEN, HIDDEN)
    out: tuple[np.ndarray, np.ndarray]  # (languages, HIDDEN)
    bias: np.ndarray

    def dump(self) -> bytes:
        buf = io.BytesIO()
        np.savez(buf, langs=np.array(self.langs), ef=self.embed[0], eb=self.embed[1], sf=self.state[0], sb=self.state[1], of=self.out[0], ob=self.out[1], bias=self.bias)
        return buf.getvalue()

    @staticmethod
    def load(raw: bytes) -> Network:
        x = np.load(io.BytesIO(raw))
        return Network([str(v) for v in x["langs"]], (x["ef"], x["eb"]), (x["sf"], x["sb"]), (x["of"], x["ob"]), x["bias"])


def _step(embed: np.ndarray, state: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state from bytes x (lanes) and states h (HIDDEN, lanes), with what the way back needs."""
    k = len(h)
    a, g = np.ascontiguousarray(embed.take(x, axis=0, mode="clip").T), state @ h
    gate = a[: 2 * k]
    gate += g[: 2 * k]
    np.clip(gate, -1, 1, out=gate)
    keep, reset, own = gate[:k], gate[k:], g[2 * k :]
    n = a[2 * k :]
    n += own
    n += reset * own
    np.clip(n, -1, 1, out=n)
    d = h - n
    new = d * keep
    new += h
    new += n
    new *= 0.5
    return new, keep, reset, own, n, d


def _train_way(embed: np.ndarray, state: np.ndarray, x: np.ndarray) -> tuple[list, list]:
    h, seen, states = np.zeros((state.shape[1], x.shape[1]), np.float32), [], []
    for row in x:
        new, keep, reset, own, n, d = _step(embed, state, row, h)
        seen.append((h, keep, reset, own, n, d))
        states.append(new)
        h = new
    return states, seen


def _back_way(state: np.ndarray, x: np.ndarray, seen: list, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the embedding and of the state matrix from those of each step's state."""
    k = state.shape[1]
    d_state, rows, dh = np.zeros_like(state), np.empty((len(x), 3 * k, x.shape[1]), np.float32), 0.0
    for t in range(len(x) - 1, -1, -1):
        h, keep, reset, own, n, d = seen[t]
        dh = dh + grads[t]
        d_keep = 0.5 * dh * d * (np.abs(keep) < 1)
        d_n = 0.5 * dh * (1 - keep) * (np.abs(n) < 1)
        d_reset = d_n * own * (np.abs(reset) < 1)
        rows[t] = np.concatenate((d_keep, d_reset, d_n))
        d_g = np.concatenate((d_keep, d_reset, d_n * (1 + reset)))
        d_state += d_g @ h.T
        dh = 0.5 * dh * (1 + keep) + state.T @ d_g
    d_embed = np.zeros((256, 3 * k), np.float32)
    np.add.at(d_embed, x.ravel(), rows.transpose(0, 2, 1).reshape(-1, 3 * k))
    return d_embed, d_state


@dataclass
class Plan:
    """What the training starts from, and which places of which texts it reads in every step: drawn from the texts' sizes alone."""

    langs: list[str]
    weights: dict[str, np.ndarray]
    label: np.ndarray
    texts: list[np.ndarray]  # for each step the text of each lane
    places: list[list[int]]  # and where the lane begins in it


def plan(labels: list[str], sizes: list[int], seed: int = 7) -> Plan:
    langs = sorted(set(labels))
    rng, c = np.random.default_rng(seed), len(langs)
    p = {f"e{w}": rng.normal(0, 0.3, (256, 3 * HIDDEN)) for w in "fb"} | {f"s{w}": rng.normal(0, 0.25, (3 * HIDDEN, HIDDEN)) for w in "fb"}
    p |= {f"o{w}": rng.normal(0, 0.3, (c, HIDDEN)) for w in "fb"} | {"bias": np.zeros((c, 1))}
    y = np.array([langs.index(x) for x in labels])
    groups = [np.flatnonzero(y == i) for i in range(c)]
    out = Plan(langs, {k: v.astype(np.float32) for k, v in p.items()}, y, [], [])
    for _ in range(UPDATES if c > 1 else 0):
        # As many lanes of each language; every lane a place in a text.
        pick = np.concatenate([rng.choice(g, -(-LANES // c)) for g in groups])
        out.texts.append(pick)
        out.places.append([int(rng.integers(0, max(1, sizes[i] - STEPS + 1))) for i in pick])
    return out


def lane(text: bytes, at: int) -> bytes:
    """STEPS bytes of a text from a place on, filled up with spaces."""
    return text[at : at + STEPS].ljust(STEPS)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """A network from labelled texts of at least one byte; one language only gives a constant."""
    return learn(plan(labels, [len(t) for t in texts], seed), lambda i, at: lane(texts[i], at))


def learn(start: Plan, read: Callable[[int, int], bytes]) -> Network:
    """Backpropagation through time over a plan's lanes; read gives the bytes of a lane."""
    langs, y, p = start.langs, start.label, start.weights
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step, (pick, places) in enumerate(zip(start.texts, start.places, strict=True), 1):
        x = np.frombuffer(b"".join(map(read, pick.tolist(), places)), np.uint8).reshape(-1, STEPS).T.astype(np.int64)
        hf, seen_f = _train_way(p["ef"], p["sf"], x)
        hb, seen_b = _train_way(p["eb"], p["sb"], x[::-1])
        hf, hb = np.stack(hf), np.stack(hb[::-1])
        z = p["of"] @ hf + p["ob"] @ hb + p["bias"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[:, y[pick], np.arange(len(pick))] -= 1
        q /= q.shape[0] * q.shape[2]
        g = {"bias": q.sum(axis=(0, 2))[:, None], "of": np.tensordot(q, hf, ((0, 2), (0, 2))), "ob": np.tensordot(q, hb, ((0, 2), (0, 2)))}
        g["ef"], g["sf"] = _back_way(p["sf"], x, seen_f, p["of"].T @ q)
        g["eb"], g["sb"] = _back_way(p["sb"], x[::-1], seen_b, (p["ob"].T @ q)[::-1])
        norm = np.sqrt(sum(float((u * u).sum()) for u in g.values()))
        rate = RATE * min(1.0, 3 * (1 - step / (UPDATES + 1)))
        for k in p:
            u = g[k] * min(1.0, 1 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * u
            v[k] = 0.99 * v[k] + 0.01 * u * u
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Network(langs, (p["ef"], p["eb"]), (p["sf"], p["sb"]), (p["of"], p["ob"]), p["bias"])


def _lanes(net: Network, x: np.ndarray, active: list[int], lens: np.ndarray, label: np.ndarray | None) -> np.ndarray:
    """Sums of position probabilities (languages, lanes); x: (steps, lanes), lanes by falling length; label: gets each position's language."""
    c, (steps, n) = len(net.langs), x.shape
    ahead, h = np.empty((steps, c, n), np.float32), np.zeros((HIDDEN, n), np.float32)
    for t in range(steps):
        k = active[t]
        h = _step(net.embed[0], net.state[0], x[t, :k], h[:, :k])[0]
        ahead[t, :, :k] = net.out[0] @ h
    h, total = np.zeros((HIDDEN, 0), np.float32), np.zeros((c, n), np.float64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        if h.shape[1] < k:
            h = np.concatenate((h, np.zeros((HIDDEN, k - h.shape[1]), np.float32)), axis=1)
        h = _step(net.embed[1], net.state[1], x[t, :k], h)[0]
        z = net.out[1] @ h
        z += net.bias
        z += ahead[t, :, :k]
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        total[:, :k] += z
        if label is not None:
            label[t, :k] = z.argmax(axis=0)
    return total


def probabilities(net: Network, texts: list[bytes], labels: bool = False) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """(texts, languages) mean probabilities; with labels also each text's language number at every byte."""
    c = len(net.langs)
    if c == 1:
        return np.ones((len(texts), 1)), [np.zeros(len(t), np.int8) for t in texts] if labels else None
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    count = -(-size // READ)
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.concatenate(([0], np.cumsum(size)))
    first = np.concatenate(([0], np.cumsum(count)))
    start = at[doc] + (np.arange(len(doc)) - first[doc]) * READ
    lens = np.minimum(READ, at[doc + 1] - start)
    order, out = np.argsort(-lens, kind="stable"), np.zeros((len(doc), c))
    found = np.zeros(len(data), np.int8) if labels else None
    padded = np.concatenate((data, np.full(READ, 32, np.uint8)))
    for lo in range(0, len(order), WIDE):
        own = order[lo : lo + WIDE]
        steps = int(lens[own[0]])
        x = padded[start[own] + np.arange(steps)[:, None]].astype(np.intp)
        active = (len(own) - np.searchsorted(lens[own][::-1], np.arange(1, steps + 1))).tolist()
        label = np.zeros((steps, len(own)), np.int8) if labels else None
        out[own] = _lanes(net, x, active, lens[own], label).T
        if labels:
            for j, i in enumerate(own):
                found[start[i] : start[i] + lens[i]] = label[: lens[i], j]
    total = np.zeros((len(texts), c))
    np.add.at(total, doc, out)
    return total / np.maximum(size, 1)[:, None], np.split(found, at[1:-1]) if labels else None


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from docs (doc_id, text, lang): those with a language and a letter that are not held out.

    A bounded sample is used: of each language an equal part of `sample`, its documents of smallest hash (taken as
    a number without sign), with their whole texts; every step of the training reads places of them anew. None if there is no such document.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    rows = usable.select(F.lower(F.col("text").cast("string")).alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-sizes")  # a row a language
    each = -(-sample // max(1, sizes.count()))
    # Hashes below a bound that four times as many as needed should meet are ranked, so a language's size makes no task large.
    place = F.shiftrightunsigned("h", 11) / float(1 << 53)
    near = rows.select("lang", "h").distinct().join(small(sizes), "lang").where(place * F.col("n") < 4 * each)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    picked = materialize(near.withColumn("r", rank).where(F.col("r") <= each).select("lang", "h"), "langid-sample")
    # A row that repeats counts once.
    few = rows.join(small(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = materialize(few, "langid-texts")
    got = sorted(few.select("h", "lang", F.octet_length("text").alias("n")).collect())  # names and numbers of the sample
    if not got:
        return None
    start = plan([r.lang for r in got], [r.n for r in got])
    asked: dict[tuple[int, str], set[int]] = {}
    for pick, places in zip(start.texts, start.places, strict=True):
        for i, at in zip(pick.tolist(), places, strict=True):
            asked.setdefault((got[i].h, got[i].lang), set()).add(at)
    want = docs.sparkSession.sparkContext.broadcast({k: sorted(v) for k, v in asked.items()})
    # Of the texts, whatever their lengths, only the lanes that are read come to the driver: UPDATES * LANES * STEPS bytes at most.
    lanes = few.mapInPandas(_lanes_of(want), "h long, lang string, lanes binary").collect()
    held = {(r.h, r.lang, at): bytes(r.lanes[k * STEPS : (k + 1) * STEPS]) for r in lanes for k, at in enumerate(want.value[r.h, r.lang])}
    return learn(start, lambda i, at: held[got[i].h, got[i].lang, at])


def _lanes_of(want):
    """The lanes that are asked for of each text, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, lang, text in zip(pdf["h"], pdf["lang"], pdf["text"], strict=True):
                if places := want.value.get((h, lang)):
                    raw = text.encode("utf-8", "replace")
                    out.append((h, lang, b"".join(lane(raw, at) for at in places)))
            if out:
                yield pd.DataFrame(out, columns=["h", "lang", "lanes"])

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text).

    lang_pred is `und` with score 0 if the text is null or has no letter, or if there is no network;
    otherwise the language of largest mean probability over all bytes (lower-cased), ties to the first by
    name, and score that mean. Every text is read whole, in stretches of READ bytes that are judged each by itself. Rows that repeat a doc_id are judged each; a null
    doc_id is not held out; an empty table gives an empty result; other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.when(text.rlike(r"\p{L}"), F.lower(text)).alias("text"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    raw = net.dump()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Network.load(raw)
        for pdf in batches:
            for part in _parts(pdf):
                texts = [t.encode("utf-8", "replace") if t else b"" for t in part["text"]]
                p, _ = probabilities(own, texts)
                best = p.argmax(axis=1)
                some = np.array([bool(t) for t in texts])
                names = np.where(some, np.array(own.langs, dtype=object)[best], "und")
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": names, "score": np.where(some, p[np.arange(len(p)), best], 0.0)})

    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _parts(pdf: pd.DataFrame, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """pdf in consecutive parts of about that many characters, at least a row each."""
    if not len(pdf):
        return
    part = pdf["text"].str.len().fillna(0).cumsum() // most
    for _, rows in pdf.groupby(part.to_numpy(), sort=False):
        yield rows
