"""Word and shingle hashes of many texts at once, in numpy, inside Spark tasks.

A word's hash is a polynomial in random byte values modulo 2**64, taken from running sums over the whole
batch, so no Python loop runs over words. Texts are cut into blocks at separators, so memory stays bounded
by the block and by one document's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
_RNG = np.random.default_rng(20240101)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_PW, _PWI = _powers(_BASE, BLOCK + 2), _powers(_INVERSE, BLOCK + 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _block(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of raw, in order; breaks: which bytes end words."""
    global _PW, _PWI
    if len(raw) + 1 > len(_PW):  # one word longer than a block
        _PW, _PWI = _powers(_BASE, len(raw) + 2), _powers(_INVERSE, len(raw) + 2)
    gap = np.concatenate(([True], breaks[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * _PW[: len(raw)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * _PWI[starts])


def spans(texts: list[str | None], breaks: np.ndarray = SPACE, fold: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, all words' starts, ends and hashes in order, and for each text where its words begin (one more entry at the end)."""
    raw = " ".join(t or "" for t in texts).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    lens = np.fromiter((len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(lens)))
    found, lo = [], 0
    while lo < len(data):
        hi = min(lo + BLOCK, len(data))
        while hi < len(data):
            cut = np.flatnonzero(breaks[data[lo:hi]])
            if len(cut):
                hi = lo + int(cut[-1]) + 1
                break
            hi = min(hi + BLOCK, len(data))
        part = data[lo:hi]
        s, e, h = _block(fold[part] if fold is not None else part, breaks)
        found.append((s + lo, e + lo, h))
        lo = hi
    s, e, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return raw, s, e, h, np.searchsorted(s, at)


def words(texts: list[str | None], breaks: np.ndarray = SPACE, fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and for each text where its words begin (one more entry at the end)."""
    _, _, _, h, at = spans(texts, breaks, fold)
    return h, at


def shingles(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles (not distinct), and where each text's begin.

    A text with fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    w, at = words(texts)
    n = np.diff(at)
    every = np.zeros(len(w), dtype=np.uint64)
    for j in range(k):
        part = w[j:]
        with np.errstate(over="ignore"):
            every[: len(part)] = every[: len(part)] * _STEP + part
    keep = np.zeros(len(w), dtype=bool)
    for i in np.flatnonzero(n):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= k:
            keep[lo : hi - k + 1] = True
        else:
            whole = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for x in w[lo:hi]:
                    whole = whole * _STEP + x
            every[lo], keep[lo] = whole, True
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    return mix(every[keep]), np.concatenate(([0], np.cumsum(count)))


def distinct_sets(texts: list[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    h, at = shingles(texts, k)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield np.unique(h[lo:hi])
