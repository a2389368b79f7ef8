"""Periodic runs of words: descending-LCP Kruskal over suffix classes.

A run is a stretch of consecutive words in which words ``period`` apart are equal, ``period`` being the smallest such
number, at least ``min_length`` words and ``min_repeats`` periods long, and not extendable by a word on either side.

The suffixes of a document's words are sorted by prefix doubling; the names of the doubled windows also give the common
prefix (LCP) of neighbours. The neighbours are then united by falling LCP: a class holds the ordered set
of positions whose suffixes share at least so many words, and the smaller set goes into the larger. Two positions that
become adjacent in a set when classes unite at LCP ``l`` share exactly ``l`` words, so if they lie at a distance
``d <= l`` the words from the first on have period ``d``, up to ``l`` words behind the second and no further. Such a pair seeds the
run of that end and period; the first position of all its pairs is the run's start. A pair at a multiple of the
period is never adjacent, for the positions between share more words and are in the set before.

A run of the least length has a pair that shares ``floor`` words (16 for 24 words and 3 periods), so no
union below that can seed one and the unions end there; documents without a repeated window of ``floor`` words
have no run. Both follow from the definition; nothing is left out.

Words are the runs of bytes that are not ASCII white space, compared byte by byte. Null texts count as empty and have no
words. A document is worked on as a whole, in n log n; rows are independent of each other, so repeated
rows and ids do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .hashing import MULT, mix, powers

SLICE_BYTES = 1 << 20  # text turned into words at a time


def least_common(min_length: int, min_repeats: int) -> int:
    """Words that the pair at a run's start shares at least."""
    return min(max(min_length - q, (min_repeats - 1) * q) for q in range(1, min_length + 1))


def neighbours(x: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, LCP) of neighbouring suffixes that share ``floor`` words or more, by falling LCP. ``x``: a number for each word."""
    n = len(x)
    names = [np.unique(x, return_inverse=True)[1].astype(np.int32)]  # of the windows of 1, 2, 4, ... words
    width = 1
    while names[-1].max() < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: n - width] = names[-1][width:].astype(np.int64) + 1 if width < n else 0
        names.append(np.unique(names[-1].astype(np.int64) * (n + 1) + behind, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.argsort(names[-1], kind="stable")
    i, j = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(names) - 2, -1, -1):
        a, b = i + common, j + common
        both = np.flatnonzero((a < n) & (b < n))
        same = both[names[k][a[both]] == names[k][b[both]]]
        common[same] += 1 << k
    have = np.flatnonzero(common >= floor)
    have = have[np.argsort(-common[have], kind="stable")]
    return i[have], j[have], common[have]


def runs_of(x: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start and period."""
    if len(x) < max(2, min_length):
        return []
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    seeds: dict[tuple[int, int], int] = {}

    def root(p: int) -> int:
        if p not in parent:
            parent[p], places[p] = p, [p]
            return p
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    def seed(a: int, b: int, common: int) -> None:
        if b - a <= common:
            seeds[b + common, b - a] = min(a, seeds.get((b + common, b - a), a))

    for a, b, common in zip(*(v.tolist() for v in neighbours(x, least_common(min_length, min_repeats)))):
        a, b = root(a), root(b)
        if len(places[a]) < len(places[b]):
            a, b = b, a
        parent[b] = a
        into, new = places[a], places.pop(b)
        own = set(new) if len(new) > 1 else ()
        for p in new:
            insort(into, p)
        for p in new:
            k = bisect_left(into, p)
            if k and into[k - 1] not in own:
                seed(into[k - 1], p, common)
            if k + 1 < len(into) and into[k + 1] not in own:
                seed(p, into[k + 1], common)
    found = ((start, end - start, period) for (end, period), start in seeds.items())
    return sorted((s, n, q) for s, n, q in found if n >= max(min_length, min_repeats * q))


def _repeating(x: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """The documents that hold some window of ``width`` words twice (by hash: a few others as well)."""
    n = len(x) - width + 1
    if n <= 1:
        return np.empty(0, np.int64)
    up, down = powers(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    key = mix(mix((sums[at + width] - sums[at]) * down[at]) + doc[at].astype(np.uint64) * np.uint64(MULT))
    order = np.argsort(key)
    return np.unique(doc[at[order[1:][key[order][1:] == key[order][:-1]]]])


def _slice(texts: list[bytes], min_length: int, min_repeats: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each text."""
    ids: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    x = np.array([ids.setdefault(w, len(ids)) for ws in split for w in ws], np.int64)
    size = np.fromiter(map(len, split), np.int64, len(split))
    end = np.cumsum(size)
    runs: list[list[dict]] = [[] for _ in texts]
    for d in _repeating(x, np.repeat(np.arange(len(split)), size), least_common(min_length, min_repeats)).tolist():
        found = runs_of(x[end[d] - size[d] : end[d]], min_length, min_repeats)
        if found:
            runs[d] = [{"start": s, "length": n, "period": q} for s, n, q in found]
            drop = np.zeros(size[d] + 1, np.int64)
            for s, n, q in found:
                drop[s + q] += 1
                drop[s + n] -= 1
            split[d] = [w for w, gone in zip(split[d], (np.cumsum(drop) > 0).tolist()) if not gone]
    return runs, [b" ".join(ws) for ws in split]


def detect(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", min_length: int = 24, min_repeats: int = 3) -> DataFrame:
    """``docs`` with two more columns: the runs of ``text``, array<struct<start, length, period>> by start and period, and
    its words joined by one space without those that a run holds behind its first period."""
    if min_repeats < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = "array<struct<start: long, length: long, period: long>>"
    schema = T.StructType([*docs.schema.fields, T.StructField(runs, T._parse_datatype_string(kind)), T.StructField(collapsed, T.StringType())])
    at = docs.columns.index(text)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(size) // SLICE_BYTES, prepend=0)).tolist()
            for begin, end in zip([0, *cut], [*cut, len(size)]):
                if end > begin:
                    part = batch.slice(begin, end - begin)
                    found, rest = _slice([t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()], min_length, min_repeats)
                    new = [pa.array(found, arrow), pa.array(rest, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, runs, collapsed])

    return docs.mapInArrow(run, schema)
