"""Vectorised 64-bit hashes of substrings, words and word shingles of a block."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULT = 0x9E3779B97F4A7C15
INVERSE = pow(MULT, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULT))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for m in (MULT, INVERSE):
        p = np.full(n + 1, m, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return tuple(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n (and more) of the multiplier, and of its inverse modulo 2**64."""
    return _powers(((int(n) >> 20) + 1) << 20)


class Prefixes:
    """Prefix polynomial hashes; the hash of any substring in constant time, equal for equal bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        part = BYTE[raw]
        part *= up[: len(raw)]
        np.cumsum(part, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of raw[start:end]; compare only those of equal length, or mix the length in."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, size: int) -> np.ndarray:
        """The mixed hash of raw[p : p + size] for every p."""
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        h = self.sums[size:] - self.sums[:n]
        h *= self.down[:n]
        return mix(h)


def words(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of bytes that are not white space; none crosses a document's border."""
    ink = ~SPACE[raw]
    first, last = ink.copy(), ink.copy()
    if len(raw):
        border = np.zeros(len(raw) + 1, bool)
        border[starts] = True
        first[1:] &= ~ink[:-1] | border[1:-1]
        last[:-1] &= ~ink[1:] | border[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(starts + sizes, begin, side="right")


def shingle_sets(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash): each document's distinct shingles of ``width`` words, A-Z lower-cased, sorted by document and hash.

    A document with fewer words has one shingle, all its words; without words it has none.
    """
    raw = LOWER[raw]
    begin, end, doc = words(raw, starts, sizes)
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = mix(Prefixes(raw).spans(begin, end) + (end - begin).astype(np.uint64))
    count = np.bincount(doc, minlength=len(sizes))
    first = np.cumsum(count) - count
    found = []
    for size in range(1, width + 1):  # below ``width`` only for documents of just so many words
        at = np.flatnonzero(np.arange(len(word)) - first[doc] + size <= count[doc]) if size == width else first[count == size]
        if len(at):
            h = np.full(len(at), size, np.uint64)
            for j in range(size):
                h = mix(h * np.uint64(MULT) + word[at + j])
            found.append((doc[at], h))
    doc, h = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]
