"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams (``NGRAMS``) of its words, ``<`` and
``>`` marking a word's ends, hashed to ``BUCKETS`` rows of an embedding table;
their average goes through a linear softmax. Words that nobody has seen, such
as misspellings, share the n-grams of those that were. The table and the
softmax are trained together by Adam on a bounded sample of labelled rows:
``sample_rows`` rows of each label, of at most ``sample_chars`` characters
each, weighted back to the labels' frequencies. Broadcast is only the fitted
table folded with the softmax: one number for each bucket.

Whole texts are scored. Null texts and texts without words get the labels'
base rate, as all texts do if the labels are all alike; without labels it is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _slices
from .common import fresh, held, held_out, stored

NGRAMS, BUCKETS, MEMO_WORDS = (3, 4, 5), 1 << 17, 300_000
MULT, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 17)
WORDS = re.compile(r"[^\W_]+(?:[^\w\s][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def ngrams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets: word x n-gram) for the words of each byte length; a word shorter than an n-gram is one whole."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        m = np.frombuffer(b"".join([raw[k] for k in at.tolist()]), np.uint8).reshape(len(at), n)
        m = np.asfortranarray(m).astype(np.uint64, order="F")
        got = []
        for length in [x for x in NGRAMS if x <= n] or [n]:
            for start in range(n - length + 1):
                h = np.full(len(at), length, np.uint64)
                for j in range(start, start + length):
                    h = (h ^ m[:, j]) * MULT
                    h ^= h >> np.uint64(31)
                got.append((h * MULT >> SHIFT).astype(np.int64))
        yield at, np.stack(got, 1)


class Model:
    """value[bucket]: embedding times softmax weight (label 1 less label 0); bias; base rate."""

    def __init__(self, value: np.ndarray, bias: float, base: float):
        self.value, self.bias, self.base = value, bias, base
        self.taught = bool(value.any())
        self.memo: dict[str, int] = {}
        self.words = np.empty((0, 2))  # sum of values, number of n-grams

    def __getstate__(self):
        return self.value, self.bias, self.base

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, texts: list[str | None]) -> list[float]:
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.words = {}, np.empty((0, 2))
        words = [words_of(t) for t in texts]
        if new := list(set().union(*words).difference(self.memo)):
            got = np.empty((len(new), 2))
            for at, b in ngrams(new):
                got[at, 0], got[at, 1] = self.value[b].sum(1), b.shape[1]
            self.memo.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.words = np.vstack([self.words, got])
        get, out = self.memo.__getitem__, []
        for ws in words:
            if not ws or not self.taught:
                out.append(self.base)
                continue
            total, n = self.words[list(map(get, ws))].sum(0)
            out.append(float(1 / (1 + np.exp(-np.clip(self.bias + total / n, -60, 60)))))
        return out


def fit(texts: list[str], labels: np.ndarray, base: float, dims: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.1,
        decay: float = 1e-5, least_docs: int = 4, seed: int = 7) -> Model:
    """Train embeddings and softmax jointly. ``base``: share of label 1 among all labelled rows."""
    words = [words_of(t) for t in texts]
    of: dict[str, np.ndarray] = {}
    known = sorted(set().union(*words))
    for at, b in ngrams(known):
        of.update(zip([known[k] for k in at.tolist()], b))
    cols, vals = [], []
    for ws in words:
        b, n = np.unique(np.concatenate([of[w] for w in ws] or [np.empty(0, np.int64)]), return_counts=True)
        cols.append(b)
        vals.append(n / max(1, n.sum()))
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), float(np.log((base + 1e-9) / (1 - base + 1e-9))), base)
    # n-grams of a few rows only teach their rows by heart: they keep a zero embedding
    common = np.flatnonzero(np.bincount(np.concatenate(cols), minlength=BUCKETS) >= least_docs)
    place = np.full(BUCKETS, -1)
    place[common] = np.arange(len(common))
    keep = [place[c] >= 0 for c in cols]
    cols, vals = [place[c[k]] for c, k in zip(cols, keep)], [v[k].astype(np.float32) for v, k in zip(vals, keep)]
    ptr = np.cumsum([0, *map(len, cols)])
    col, val = np.concatenate(cols), np.concatenate(vals)
    rng = np.random.default_rng(seed)
    emb, soft = rng.normal(0, 0.1, (len(common), dims)).astype(np.float32), rng.normal(0, 0.1, (dims, 2)).astype(np.float32)
    bias = np.log(np.array([1 - base, base], np.float32))
    weight = np.where(labels == 1, base / labels.mean(), (1 - base) / (1 - labels.mean())).astype(np.float32)
    params = [emb, soft, bias]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            rows = rows[ptr[rows + 1] > ptr[rows]]
            if not len(rows):
                continue
            size = ptr[rows + 1] - ptr[rows]
            first = np.cumsum(size) - size
            idx = np.repeat(ptr[rows] - first, size) + np.arange(size.sum())
            c, v = col[idx], val[idx]
            vec = np.add.reduceat(emb[c] * v[:, None], first)
            z = vec @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            g = p * (weight[rows] / len(rows))[:, None]
            back = np.repeat(g @ soft.T, size, 0) * v[:, None]
            grads = [np.stack([np.bincount(c, back[:, d], len(common)) for d in range(dims)], 1), vec.T @ g, g.sum(0)]
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, grad in enumerate(grads):
                grad = grad + decay * params[k] * (k < 2)
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.99 * m2[k] + 0.01 * grad**2
                params[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    value = np.zeros(BUCKETS)
    value[common] = emb @ (soft[:, 1] - soft[:, 0])
    return Model(value, float(bias[1] - bias[0]), base)


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
           sample_rows: int = 2000, sample_chars: int = 20_000) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of the labelled rows of smallest hash for each label, and the share of label 1 among all.

    Only rows of at most ``sample_chars`` characters are picked; of a label without such rows the shortest, by their
    first ``sample_chars`` characters. An id that has both labels counts as label 1.
    """
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(
        F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy("id").agg(F.max("y").alias("y"))
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.length(text).alias("size"), F.xxhash64(text).alias("h"))
    found = stored(texts.drop("text").join(rows, "id"), "labelled")
    short = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count_if(F.col("size") <= sample_chars).alias("n")).collect()}
    if not short:
        return [], np.empty(0, np.int64), count.get(1, 0) / sum(count.values()) if count else 0.0
    n = F.try_element_at(F.create_map(*[F.lit(x) for kv in short.items() for x in kv]), F.col("y"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = found.where((n == 0) | (F.col("size") <= sample_chars) & (place * n < 2.0 * sample_rows)).select("id", "y", "h", F.when(n == 0, F.col("size")).otherwise(0).alias("size")).distinct()
    order = Window.partitionBy("y").orderBy("size", F.xxhash64("id"), "id", "h")
    picked = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_rows).select("id", "y", "h")
    # At most 2 * sample_rows ids: small enough to broadcast.
    got = texts.join(F.broadcast(picked), ["id", "h"]).select("id", F.substring("text", 1, sample_chars).alias("text"), "y").distinct()
    pairs = sorted((r["id"], r["text"], r["y"]) for r in got.toLocalIterator())
    return [t for _, t, _ in pairs], np.array([y for *_, y in pairs], np.int64), count.get(1, 0) / sum(count.values())


def predict(text: Column, spark: SparkSession, model: Model) -> Column:
    shared, key = spark.sparkContext.broadcast(model), fresh("m")

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held("toxicity", key, lambda: Model(*shared.value.__getstate__()))
        for s in batches:
            yield pd.Series([x for run in _slices(list(s)) for x in model.score(run)], dtype=float)

    return toxicity(text)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", out: str = "toxicity", **bounds) -> DataFrame:
    """``docs`` with a column ``out``: the probability of label 1."""
    texts, y, base = sample(docs, labels, text, doc_id, label, **bounds)
    return docs.withColumn(out, predict(F.col(text), docs.sparkSession, fit(texts, y, base)))
