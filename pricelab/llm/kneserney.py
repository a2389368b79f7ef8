"""Language-model scoring by an interpolated modified Kneser-Ney n-gram model.

The model is counted in Spark, level by level from the longest n-grams down, and kept as sorted hash arrays in the
shared folder, which the workers map into memory to look n-grams up.

* Tokens are the words of a text with A-Z lower-cased, and one end. ``order - 1`` starts stand before a text as
  context; they are never predicted.
* Level ``order``: tasks count their n-grams, merge what they have and send it, Rice-coded by hash, to the owners
  of hash ranges. An n-gram is one entry a list however often it occurs, and ranges of hashes are even, so no key is hot.
  An owner adds up its lists and writes one shard: sorted keys and counts.
* Levels below: the texts are read again, the counts of the longer n-grams are looked up in the level above, and each
  occurrence of one that occurs ``c`` times carries ``1 / c``. Summed over all texts this is one for each
  different n-gram, wherever its copies lie: the number of different words before a (shorter) n-gram, its
  count in Kneser-Ney; and for a context the number of different words behind it that occur once, twice, and
  more often. The sums are rounded to the integers that they are.
* The discounts of a level follow from how many of its n-grams count 1, 2, 3 and 4. A discount that these leave
  undefined or not positive is half of its count (0.5, 1, 1.5).
* p(w | context) = (count - discount) / all + weight(context) * p(w | shorter context); the last shorter
  one is uniform over the V different tokens and one for all unknown words, so the probabilities of a context add up to one.
  The context of n-grams that begin with a start has their plain counts.

Words are told apart by 64-bit hashes, longer n-grams by ``log2(all tokens) + 24`` bits: an n-gram shares its key with
one of the others with a probability of about 2**-24 at any size. Counts and keys cover all the training texts. Workers keep
no part of the model; a shard is mapped while a slice's sorted keys are looked up in it.

Null and empty texts are one token, the end. Repeated rows count and score each. Without training texts every token is
unknown, with probability one. An empty table gives no rows. The shared folder must be a path that all workers have
mounted, since files of other stores can't be mapped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare_session, scratch_path
from .exchange import owner_bounds, rice_decode, rice_encode
from .hashing import LOWER, MULT, Prefixes, mix, words

START, END = np.split(mix(np.array([0x53, 0x45], np.uint64) * np.uint64(MULT)), 2)  # arrays of one hash
SLICE_BYTES = 1 << 20  # text that is hashed at a time
PENDING = 1_500_000  # entries that a task merges before it sends them
OWNER_SHARE = 1_500_000  # entries that an owner gets
FIELDS = {True: 1, False: 6}  # a list's columns at the highest level (count), and below (see ``_below``)
STATS = "n1 long, n2 long, n3 long, n4 long, a long, raw long, tokens long"


class Tokens:
    """Hashes of the tokens of some texts, and of the n-grams that end at each."""

    def __init__(self, texts: list[bytes], order: int):
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        raw = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        begin, end, doc = words(raw, np.cumsum(sizes) - sizes, sizes)
        h = mix(Prefixes(raw).spans(begin, end) + (end - begin).astype(np.uint64))
        self.count = np.bincount(doc, minlength=n) + 1
        last = np.cumsum(self.count) - 1
        self.word = np.empty(len(h) + n, np.uint64)
        inner = np.ones(len(self.word), bool)
        inner[last] = False
        self.word[inner], self.word[last] = h, END
        self.first = last + 1 - self.count
        self.place = np.arange(len(self.word)) - np.repeat(self.first, self.count)
        #: gram[k - 1]: the k words up to each token; context[k - 1]: the k words before it.
        self.gram, self.context = [self.word], []
        start = START
        for k in range(1, order):
            before = np.empty_like(self.word)
            before[1:] = self.gram[-1][:-1]
            before[self.first] = start
            self.context.append(before)
            back = np.repeat(START, len(self.word))
            there = self.place >= k
            back[there] = self.word[np.flatnonzero(there) - k]
            self.gram.append(mix(back * np.uint64(MULT) + self.gram[-1]))
            start = mix(START * np.uint64(MULT) + start)


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of some megabytes of text, with the whole texts as bytes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // SLICE_BYTES, prepend=0)).tolist()
        for begin, end in zip([0, *cut], [*cut, len(size)]):
            if end > begin:
                part = batch.slice(begin, end - begin)
                yield part, [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]


def added(key: np.ndarray, fields: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and the sums of their columns."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(fields[:, order], first, axis=1) if len(key) else fields


@dataclass
class Level:
    """Where one level's shards are, and how its keys are cut."""

    path: str
    k: int
    top: bool
    bits: int
    owners: int
    present: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    stats: dict = field(default_factory=dict)
    discount: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def shard(self, owner: int) -> str:
        return f"{self.path}/level{self.k}-{owner}"

    def write(self, owner: int, key: np.ndarray, columns: list[np.ndarray]) -> None:
        """One file of 8-byte words: how many keys, then each column. Any attempt of a task writes the same bytes."""
        os.makedirs(self.path, exist_ok=True)
        part = f"{self.shard(owner)}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for x in (np.array([len(key)], np.uint64), key, *columns):
                f.write(np.ascontiguousarray(x).tobytes())
        os.replace(part, self.shard(owner))

    def find(self, key: np.ndarray) -> list[np.ndarray]:
        """Columns of the keys (zeros where the level has none): at the top the count; below raw, count, all, weight."""
        uniq, back = np.unique(key >> np.uint64(64 - self.bits), return_inverse=True)
        out = [np.zeros(len(uniq)) for _ in range(1 if self.top else 4)]
        cut = np.append(np.searchsorted(uniq, owner_bounds(self.owners, self.bits)), len(uniq))
        have = np.zeros(self.owners, bool)
        have[self.present] = True
        for owner in np.flatnonzero((np.diff(cut) > 0) & have).tolist():
            low, high = cut[owner], cut[owner + 1]
            shard = np.memmap(self.shard(owner), np.uint8, "r")
            n = int(shard[:8].view(np.uint64)[0])
            keys = shard[8 : 8 + 8 * n].view(np.uint64)
            at = np.minimum(np.searchsorted(keys, uniq[low:high]), n - 1)
            hit = np.flatnonzero(keys[at] == uniq[low:high])
            at = at[hit]
            rest = shard[8 + 8 * n :]
            if self.top:  # a byte each; 255: in the list of larger counts behind
                count = rest[:n][at].astype(np.float64)
                large = np.flatnonzero(count == 255)
                if len(large):
                    more = np.frombuffer(rest[n:].tobytes(), np.uint64).reshape(2, -1)
                    count[large] = more[1][np.searchsorted(more[0], at[large].astype(np.uint64))]
                out[0][low + hit] = count
            else:
                for j, o in enumerate(out):
                    o[low + hit] = rest[8 * n * j : 8 * n * (j + 1)].view(np.float64)[at]
            del shard, keys, rest
        return [o[back] for o in out]


def discounts(n: dict) -> np.ndarray:
    """Of counts 0, 1, 2, and 3 or more."""
    n1, n2, n3, n4 = (float(n[f"n{r}"] or 0) for r in (1, 2, 3, 4))
    out = np.array([0, 0.5, 1, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for r, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            if a and b and r - (r + 1) * y * b / a > 0:
                out[r] = r - (r + 1) * y * b / a
    return out


@dataclass
class Model:
    """A trained model: its levels from single words up."""

    levels: list[Level]

    @property
    def tokens(self) -> int:
        return self.levels[0].stats["raw"] or 0

    @property
    def different(self) -> int:
        return self.levels[0].stats["tokens"] or 0

    def scores(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Of each text: tokens, known ones, log10 probability by single words plus one, and by the model."""
        t = Tokens(texts, len(self.levels))
        low, alone = self.levels[0], len(self.levels) == 1
        columns = low.find(t.word)
        raw, count = columns[0], columns[0 if alone else 1]
        base = np.log10((raw + 1) / (self.tokens + self.different + 1))
        p = np.full(len(t.word), 1 / (self.different + 1))
        if total := float(low.stats["a"] or 0):
            n = [low.stats["n1"], low.stats["n2"]]
            left = low.discount[1] * n[0] + low.discount[2] * n[1] + low.discount[3] * (self.different - sum(n))
            p = (count - low.discount[np.minimum(count, 3).astype(int)]) / total + left / total * p
        for k in range(1, len(self.levels)):
            level = self.levels[k]
            count = level.find(t.gram[k])[0 if level.top else 1]
            *_, all_, weight = self.levels[k - 1].find(t.context[k - 1])
            seen = all_ > 0
            p = np.where(seen, (count - level.discount[np.minimum(count, 3).astype(int)]) / np.where(seen, all_, 1) + np.where(seen, weight, 1) * p, p)
        add = lambda x: np.add.reduceat(x, t.first) if len(t.first) else x
        return {"n_tokens": t.count, "n_known": add((raw > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}


def _top(t: Tokens, k: int, _) -> tuple[np.ndarray, np.ndarray]:
    return t.gram[k - 1], np.ones((1, len(t.word)))


def _below(t: Tokens, k: int, above: Level) -> tuple[np.ndarray, np.ndarray]:
    """Keys and columns of level k: occurrences, Kneser-Ney count; as a context: all, and words behind it by count."""
    columns = above.find(t.gram[k])
    raw, count = columns[0], columns[0 if above.top else 1]
    n = len(raw)
    fields = np.zeros((6, 2 * n))
    fields[0, :n] = 1
    fields[1, :n] = np.where(t.place < k - 1, 1, 1 / raw)  # one that begins with a start counts as often as it occurs
    fields[2, n:] = count / raw
    for r in (1, 2, 3):
        fields[2 + r, n:] = np.where(np.minimum(count, 3) == r, 1 / raw, 0)
    return np.concatenate([t.gram[k - 1], t.context[k - 1]]), fields


def _count(texts: DataFrame, level: Level, order: int, made: Callable, above: Level | None, below_of: np.ndarray | None) -> Level:
    """Build one level; ``below_of``: the discounts of the level above, for the weights of its contexts."""
    shift, width = np.uint64(64 - level.bits), FIELDS[level.top]

    def lists(key: np.ndarray, fields: np.ndarray) -> Iterator[pa.RecordBatch]:
        low = owner_bounds(level.owners, level.bits)
        cut = np.append(np.searchsorted(key, low), len(key))
        for owner in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[owner], cut[owner + 1])
            k, code = rice_encode(key[part], int(low[owner]))
            body = pa.Codec("zstd", compression_level=3).compress(np.ascontiguousarray(fields[:, part]).tobytes(), asbytes=True)
            yield pa.record_batch([pa.array([owner], pa.int32()), pa.array([cut[owner + 1] - cut[owner]], pa.int32()), pa.array([k], pa.int32()),
                                   pa.array([code], pa.binary()), pa.array([body], pa.binary())], names=["owner", "n", "k", "code", "body"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, some in _slices(batches, 0):
            key, fields = made(Tokens(some, order), level.k, above)
            parts.append(added(key >> shift, fields))
            size += len(parts[-1][0])
            if size > PENDING:
                parts = [added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1))]
                size = len(parts[0][0])
                if size > PENDING // 2:
                    yield from lists(*parts[0])
                    parts, size = [], 0
        if parts:
            yield from lists(*added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        owner = int(pdf["owner"].iloc[0])
        low = int(owner_bounds(level.owners, level.bits)[owner])
        rows = list(zip(pdf["n"].tolist(), pdf["k"].tolist(), pdf["code"], pdf["body"]))
        key = np.concatenate([rice_decode(code, n, k, low) for n, k, code, _ in rows])
        fields = np.concatenate([np.frombuffer(pa.Codec("zstd").decompress(body, 8 * width * n, asbytes=True)).reshape(width, n) for n, _, _, body in rows], axis=1)
        key, fields = added(key, fields)
        fields = np.rint(fields)
        if level.top:
            raw = count = fields[0]
            large = np.flatnonzero(raw >= 255)
            level.write(owner, key, [np.minimum(raw, 255).astype(np.uint8), large.astype(np.uint64), raw[large].astype(np.uint64)])
        else:
            raw, count, all_, *n = fields
            weight = np.where(all_ > 0, sum(d * x for d, x in zip(below_of[1:], n)) / np.maximum(all_, 1), 1)
            level.write(owner, key, [raw, count, all_, weight])
        return pd.DataFrame({"owner": [owner], **{f"n{r}": [int((count == r).sum())] for r in (1, 2, 3, 4)}, "a": [int(count.sum())],
                             "raw": [int(raw.sum())], "tokens": [int((raw > 0).sum())]})

    sent = texts.mapInArrow(send, "owner int, n int, k int, code binary, body binary")
    done = sent.groupBy("owner").applyInPandas(own, "owner int, " + STATS)
    names = [c.split()[0] for c in STATS.split(", ")]
    total = done.agg(F.collect_list("owner").alias("owners"), *(F.sum(c).alias(c) for c in names)).collect()[0]
    # One number a shard, that is one for some million n-grams, comes to the driver.
    level.present = np.array(sorted(total["owners"]), np.int64)
    level.stats = {c: total[c] for c in names}
    level.discount = discounts(level.stats)
    return level


def train(docs: DataFrame, text: str = "text", order: int = 2, owner_share: int = OWNER_SHARE) -> Model:
    """A model of ``order`` words of all texts of ``docs``."""
    spark = docs.sparkSession
    prepare_session(spark)
    path = scratch_path(spark, "kneserney")
    if "://" in path:
        raise ValueError(f"the shared folder must be mounted, so that its files can be mapped into memory: {path}")
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    # An upper bound on the tokens: every second byte begins a word at most; prose has one in six.
    tokens = texts.agg(F.sum(F.octet_length("text") / 6 + 1)).collect()[0][0] or 0
    bits = min(64, int(np.log2(tokens + 1)) + 24)
    levels: list[Level] = []
    for k in range(order, 0, -1):
        top = k == order
        share = tokens if top else 2 * tokens if k > 1 else tokens / 2
        level = Level(path, k, top, 64 if k == 1 else bits, max(1, ceil(share / owner_share)))
        above = levels[0] if levels else None
        levels.insert(0, _count(texts, level, order, _top if top else _below, above, above.discount if above else None))
    return Model(levels)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "lm") -> DataFrame:
    """``docs`` with a struct ``out``: n_tokens, n_known, base_score, score (log10) and perplexity of ``text``."""
    names = ["n_tokens long", "n_known long", "base_score double", "score double", "perplexity double"]
    kind = T._parse_datatype_string("struct<" + ", ".join(n.replace(" ", ": ") for n in names) + ">")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in _slices(batches, at):
            got = model.scores(some)
            got["perplexity"] = 10 ** -(got["score"] / got["n_tokens"])
            cols = [pa.array(got[n.split()[0]], pa.int64() if n.endswith("long") else pa.float64()) for n in names]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(cols, [n.split()[0] for n in names])], [*part.schema.names, out])

    return docs.mapInArrow(run, schema)
