"""Exact removal of repeated passages by super-k-mer partitioning.

Every window of SPAN consecutive words has a minimiser: the smallest hash of its runs of MINI words. Consecutive
windows that share it travel as one packed string (their words, joined by spaces) to the bucket of that minimiser, so
equal windows always meet. There windows are sorted and counted, and each one's smallest doc_id is found.

A first pass counts how often and between which doc_ids each minimiser occurs. One that occurs in a single document
has no shared window, so its strings stay at home. One that occurs very often (a passage that many documents hold, with
other words before and after) is not sent to one bucket: its windows go one by one, equal ones of a task together,
each to the bucket of its own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_batches, materialize, small, small_batches
from .hashing import SPACE, mix, spans

#: Words of a window and of a minimiser.
SPAN, MINI = 13, 3
#: A minimiser that occurs more often sends single windows; shared minimisers up to this are sent to the tasks (8 bytes each).
HEAVY, KNOWN = 4096, 4_000_000
#: Shared single windows up to this are sent to the tasks.
HELD = 100_000
NOBODY = (1 << 63) - 1
#: Windows of a packed string, at most; packed strings whose windows are sorted together, about.
LONGEST, SORTED = 128, 1 << 15
_STEP, _WORD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Cut:
    """The words of some texts (bytes between white space, unchanged) and the super-k-mers of their windows."""

    def __init__(self, texts: list[str | None], span: int = SPAN, mini: int = MINI):
        self.span = span
        self.raw, self.starts, self.ends, self.hashes, self.at = spans(texts)
        n = len(self.starts)
        windows = max(n - span + 1, 0)
        text = np.repeat(np.arange(len(texts)), np.diff(self.at))
        grams = np.zeros(max(n - mini + 1, 0), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(mini):
                grams = grams * _STEP + self.hashes[j : j + len(grams)]
        low = _smallest(mix(grams), span - mini + 1)[:windows]
        inside = text[:windows] == text[span - 1 :]
        new = np.ones(windows, bool)
        new[1:] = (low[1:] != low[:-1]) | ~inside[:-1] | (text[1:windows] != text[: windows - 1])
        # Strings of at most LONGEST windows: a run that is longer (the same words again and again) is several of them.
        run = np.flatnonzero(new)
        past = np.arange(windows) - run[np.cumsum(new) - 1] if windows else np.zeros(0, np.int64)
        new |= past % LONGEST == 0
        first = np.flatnonzero(new & inside)
        every = np.flatnonzero(new | ~inside)
        stop = np.append(every, windows)[np.searchsorted(every, first, side="right")]
        #: For each super-k-mer: its minimiser, its text, its first word in all words and its number of windows.
        self.mini, self.text, self.first, self.count = low[first].view(np.int64), text[first], first, stop - first

    def place(self, first: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The place of a word in its text."""
        return first - self.at[text]

    def packed(self, first: np.ndarray, words: np.ndarray) -> list[str]:
        """The words from `first` on, joined by spaces."""
        raw, starts, ends = self.raw, self.starts, self.ends
        a, b = starts[first], ends[first + words - 1]
        # Where words are one byte apart, and that byte is a space, the text itself is the packed string.
        wide = (starts[1:] - ends[:-1] != 1) | (np.frombuffer(raw, np.uint8)[ends[:-1]] != 32)
        odd = np.concatenate(([0], np.cumsum(wide)))
        plain = odd[first + words - 1] == odd[first]
        out = []
        for i, (x, y, ok) in enumerate(zip(a.tolist(), b.tolist(), plain.tolist(), strict=True)):
            piece = raw[x:y] if ok else b" ".join(raw[starts[j] : ends[j]] for j in range(first[i], first[i] + words[i]))
            out.append(piece.decode("utf-8", "surrogatepass"))
        return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def _groups(pdf: pd.DataFrame, span: int, mini: int) -> Iterator[tuple[pd.DataFrame, Cut]]:
    """Portions of a batch and their words; documents without doc_id are left out."""
    for part in held_batches(pdf, "text"):
        part = part[part["doc_id"].notna()]
        if len(part):
            yield part, Cut(list(part["text"]), span, mini)


def _counted(span: int, mini: int):
    """(mini, n, low, high): how often a minimiser occurs in a batch, and its smallest and largest doc_id."""

    def run(batches):
        for pdf in batches:
            for part, cut in _groups(pdf, span, mini):
                doc = part["doc_id"].to_numpy(np.int64)[cut.text]
                order = np.argsort(cut.mini, kind="stable")
                value, first, n = np.unique(cut.mini[order], return_index=True, return_counts=True)
                if len(value):
                    yield pd.DataFrame({"mini": value, "n": n, "low": np.minimum.reduceat(doc[order], first), "high": np.maximum.reduceat(doc[order], first)})

    return run


def _packed(known, heavy, span: int, mini: int):
    """The super-k-mers of minimisers that are known (all, if None) and not heavy: (mini, doc_id, text_hash, place, words)."""

    def run(batches):
        for pdf in batches:
            for part, cut in _groups(pdf, span, mini):
                want = ~_among(cut.mini, heavy.value)
                if known is not None:
                    want &= _among(cut.mini, known.value)
                first, text, count = cut.first[want], cut.text[want], cut.count[want]
                if len(first):
                    ids, hashes = part["doc_id"].to_numpy(np.int64), part["text_hash"].to_numpy(np.int64)
                    yield pd.DataFrame({"mini": cut.mini[want], "doc_id": ids[text], "text_hash": hashes[text], "place": cut.place(first, text), "words": cut.packed(first, count + span - 1)})

    return run


def _windows(part: pd.DataFrame, cut: Cut, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, place, words) of the windows of heavy minimisers, in the order of texts and places."""
    want = _among(cut.mini, heavy)
    count = cut.count[want]
    first = np.repeat(cut.first[want], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    text = np.repeat(cut.text[want], count)
    return text, cut.place(first, text), cut.packed(first, np.full(len(first), cut.span))


def _single(heavy, span: int, mini: int, where: bool):
    """The windows of heavy minimisers, equal ones of a batch together: (words, low, high, found array of (doc_id, text_hash, place), empty unless asked for)."""

    def run(batches):
        for pdf in batches:
            for part, cut in _groups(pdf, span, mini):
                text, place, every = _windows(part, cut, heavy.value)
                ids, hashes = part["doc_id"].to_numpy(np.int64)[text], part["text_hash"].to_numpy(np.int64)[text]
                same: dict[str, list[int]] = {}
                for i, words in enumerate(every):
                    same.setdefault(words, []).append(i)
                rows = [(words, int(ids[i].min()), int(ids[i].max()), [(int(ids[j]), int(hashes[j]), int(place[j])) for j in i] if where else []) for words, i in same.items()]
                if rows:
                    yield pd.DataFrame(rows, columns=["words", "low", "high", "found"])

    return run


def _owned(heavy, owner, span: int, mini: int):
    """(doc_id, text_hash, low, high): runs of words covered by windows of heavy minimisers that a smaller doc_id owns."""

    def run(batches):
        for pdf in batches:
            for part, cut in _groups(pdf, span, mini):
                text, place, every = _windows(part, cut, heavy.value)
                own = owner.value
                low = np.fromiter((own.get(w, NOBODY) for w in every), np.int64, len(every))
                ids = part["doc_id"].to_numpy(np.int64)
                hit = low < ids[text]
                text, begin, end = _joined(text[hit], place[hit], span)
                if len(text):
                    yield pd.DataFrame({"doc_id": ids[text], "text_hash": part["text_hash"].to_numpy(np.int64)[text], "low": begin, "high": end})

    return run


def _joined(text: np.ndarray, place: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the runs of words that windows at neighbouring places of a text cover."""
    head = np.ones(len(text), bool)
    head[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(head)
    last = np.append(begin[1:], len(text))[: len(begin)] - 1
    return text[begin], place[begin], place[last] + span


def _among(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    at = np.searchsorted(rising, values)
    out = at < len(rising)
    out[out] = rising[at[out]] == values[out]
    return out


def owners(packed: list[str], doc_id: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the packed strings: its string, its place there and the smallest doc_id among equal windows, all found by sorting."""
    raw, starts, ends, hashes, at = spans(packed)
    word = _word_numbers(raw, starts, ends, hashes)
    count = np.diff(at) - span + 1
    text = np.repeat(np.arange(len(packed)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = at[text] + place
    key = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(span):
            key = key * _WORD + word[first + j].astype(np.uint64) + np.uint64(1)
    order = np.argsort(mix(key), kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    other = np.zeros(len(key), bool)
    for j in range(span):
        column = word[first[order] + j]
        other[1:] |= column[1:] != column[:-1]
    if (other & ~new).any():  # equal keys of different windows: sort by the words themselves
        rows = np.stack([word[first + j] for j in range(span)], axis=1)
        _, group = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        new[1:] = np.diff(group.ravel()[order]) != 0
    begin = np.flatnonzero(new)
    low = np.empty(len(key), np.int64)
    if len(key):
        low[order] = np.repeat(np.minimum.reduceat(doc_id[text][order], begin), np.diff(np.append(begin, len(key))))
    return text, place, low


def _word_numbers(raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes only."""
    _, one, number = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    data = np.frombuffer(raw, np.uint8)
    same = size == size[one][number]
    if same.all():
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if (data[np.repeat(starts, size) + step] == data[np.repeat(starts[one][number], size) + step]).all():
            return number.ravel()
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts, ends, strict=True)], dtype=np.int64)


def _judged(span: int):
    """(doc_id, text_hash, low, high): runs of words, low to high, covered by windows that a smaller doc_id has too; rows come sorted by minimiser."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        doc_id = pdf["doc_id"].to_numpy(np.int64)
        text, place, low = owners(list(pdf["words"]), doc_id, span)
        hit = low < doc_id[text]
        text, begin, end = _joined(text[hit], place[hit], span)
        rows = pdf.iloc[text]
        base = rows["place"].to_numpy(np.int64)
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "text_hash": rows["text_hash"].to_numpy(), "low": base + begin, "high": base + end})

    def run(batches):
        rest: list[pd.DataFrame] = []
        held = 0
        for pdf in batches:
            rest.append(pdf)
            held += len(pdf)
            if held < SORTED or pdf["mini"].iloc[0] == pdf["mini"].iloc[-1]:
                continue
            every = pd.concat(rest, ignore_index=True)
            done = int(np.searchsorted(every["mini"].to_numpy(), every["mini"].iloc[-1]))  # the last minimiser may go on
            if done:
                yield judge(every.iloc[:done])
            rest = [every.iloc[done:]]
            held = len(rest[0])
        if rest and len(every := pd.concat(rest, ignore_index=True)):
            yield judge(every)

    return run


def _kept(batches):
    """Each text's words without those of its runs (low, high)."""
    for pdf in batches:
        for part in held_batches(pdf, "text"):
            out, removed, total = [], [], []
            raw, starts, ends, _, at = spans(list(part["text"]))
            for i, runs in enumerate(part["runs"]):
                n = int(at[i + 1] - at[i])
                step = np.zeros(n + 1, np.int64)
                for r in runs if runs is not None else ():
                    step[r["low"]] += 1
                    step[r["high"]] -= 1
                keep = np.flatnonzero(np.cumsum(step[:n]) == 0) + at[i]
                out.append(b" ".join(raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)).decode("utf-8", "surrogatepass"))
                removed.append(n - len(keep))
                total.append(n)
            yield part.drop(columns=["text", "runs"]).assign(n_words=total, n_removed=removed, kept=out)


def repeated_runs(docs: DataFrame, span: int = SPAN, mini: int = MINI, heavy: int = HEAVY, known: int = KNOWN, held: int = HELD) -> DataFrame:
    """doc_id, text_hash, runs: for each document (doc_id, text_hash, text) with repeated windows, the runs (low, high) of words that they cover."""
    spark = docs.sparkSession
    counts = docs.mapInPandas(_counted(span, mini), "mini long, n long, low long, high long")
    counts = counts.groupBy("mini").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    shared = materialize(counts.where("low < high").select("mini", "n"), "repeats-shared")
    often = shared.where(F.col("n") > heavy).select("mini")
    # A minimiser that occurs so often is one in as many thousands: their number is checked all the same.
    many = spark.sparkContext.broadcast(_rising(often, known))
    few = shared.limit(known + 1).count() <= known
    sent = docs.mapInPandas(_packed(spark.sparkContext.broadcast(_rising(shared.select("mini"), known)) if few else None, many, span, mini), "mini long, doc_id long, text_hash long, place int, words string")
    if not few:  # too many to be known in every task: strings meet them in the shuffle to their bucket
        sent = sent.join(shared.select("mini").hint("shuffle_merge"), "mini", "left_semi")
    runs = sent.repartition("mini").sortWithinPartitions("mini").mapInPandas(_judged(span), "doc_id long, text_hash long, low int, high int")
    if len(many.value):
        runs = runs.unionByName(_runs_of_heavy(docs, many, span, mini, held))
    return runs.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("runs"))


def _runs_of_heavy(docs: DataFrame, heavy, span: int, mini: int, held: int) -> DataFrame:
    """(doc_id, text_hash, low, high) from single windows: the owners of shared ones are sent to the texts if they are few, else the texts' windows meet them in a shuffle."""
    spark, found = docs.sparkSession, "words string, low long, high long, found array<struct<doc_id: long, text_hash: long, place: int>>"
    owner = docs.mapInPandas(_single(heavy, span, mini, False), found).groupBy("words").agg(F.min("low").alias("owner"), F.max("high").alias("most"))
    owner = materialize(owner.where("owner < most").select("words", "owner"), "repeats-owners")
    few = owner.limit(held + 1).collect()
    if len(few) <= held:
        return docs.mapInPandas(_owned(heavy, spark.sparkContext.broadcast({r.words: r.owner for r in few}), span, mini), "doc_id long, text_hash long, low int, high int")
    each = materialize(docs.mapInPandas(_single(heavy, span, mini, True), found).select("words", "found"), "repeats-windows")
    got = each.join(owner, "words").select("owner", F.explode("found").alias("x")).where("owner < x.doc_id")
    return got.select("x.doc_id", "x.text_hash", F.col("x.place").alias("low"), (F.col("x.place") + span).cast("int").alias("high"))


def _rising(df: DataFrame, most: int) -> np.ndarray:
    """The values of a column in order, `most` at most."""
    return np.sort(df.limit(most).toArrow().column(0).to_numpy().astype(np.int64))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")


def remove_repeats(docs: DataFrame, span: int = SPAN, mini: int = MINI, heavy: int = HEAVY, known: int = KNOWN, held: int = HELD) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs (doc_id, text): kept has the words, joined by single spaces, that no removed window covers.

    Words are what white space separates, unchanged. A window of `span` words is removed where its words also stand, in that order, in a document
    of a smaller doc_id; windows are judged on the whole input. Null and empty texts have no words, and texts of fewer words than a
    window lose none. Rows of one doc_id never remove each other's words; rows without doc_id keep all and remove nothing. Empty tables give an
    empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    runs = materialize(repeated_runs(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), span, mini, heavy, known, held), "repeats-runs")
    mine = F.struct("doc_id", "text_hash")
    keys = small(runs.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    same = (docs["doc_id"] == F.col("id")) & (docs["text_hash"] == F.col("hash"))
    # Only texts that lose words are shuffled, to their runs.
    hit = docs.join(keys, same, "left_semi").join(runs, ["doc_id", "text_hash"]).select("doc_id", "text", "runs")
    cut = hit.mapInPandas(_kept, "doc_id long, n_words long, n_removed long, kept string")
    rest = docs.join(keys, same, "left_anti").select("doc_id", _words(F.col("text")).alias("ws"))
    rest = rest.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("ws", " ").alias("kept"))
    return cut.unionByName(rest)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS words FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
h AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY words) AS low FROM w) WHERE low < doc_id),
p AS (SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN js IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(array_to_string(list_filter(ws, lambda x, j: NOT list_contains(js, j)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN p USING (r)
"""
