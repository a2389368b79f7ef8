"""Language identification by segmentation-marginalised unigrams.

A language is a unigram model over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by the
forward algorithm; a text is the product of its words. The piece probabilities
are learnt by expectation-maximisation (forward-backward, so training
marginalises over segmentations as well) on a bounded sample of labelled rows:
``sample_rows`` rows a language, of at most ``sample_chars`` characters each.
Every language is learnt that has a labelled row with letters outside the
held-out fold, each in a task of its own. Only the fitted table is broadcast, the
pieces that a language's sample holds.

Whole texts are scored (words longer than ``WORD_BYTES`` as runs of that many
bytes). Null texts, texts without letters, and all texts if nothing could be
learnt, give ``und`` with score 0. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import fresh, held, held_out

PIECE_BYTES, WORD_BYTES, MEMO_WORDS = 8, 32, 100_000
PART = 64  # languages with a dense table at a time
UND = "und"
LETTERS = re.compile(r"[^\W\d_]+")
MULT = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Piece ids of byte strings, vectorised: a polynomial hash for each length and a sorted table of exact keys."""

    def __init__(self, path: str | None = None):
        raw = [b for b in bpe.vocabulary(path or bpe.default_path()).values() if 0 < len(b) <= PIECE_BYTES]
        self.pieces = sorted({*raw, *(bytes([b]) for b in range(256))})
        self.single = np.array([self.pieces.index(bytes([b])) for b in range(256)])
        key = np.array([self._key(p) for p in self.pieces], np.uint64)
        assert len(np.unique(key)) == len(key)
        self.bits = 22
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.keys, self.ids = np.append(key[order], np.uint64(0)), order
        used, first, count = np.unique(slot[order], return_index=True, return_counts=True)
        self.first, self.taken = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, bool)
        self.first[used], self.taken[used] = first, True
        self.deepest = int(count.max())

    @staticmethod
    def _key(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = ((h ^ (b + 1)) * int(MULT)) & (1 << 64) - 1
            h ^= h >> 29
        return h * int(MULT) & (1 << 64) - 1

    def lookup(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For a matrix of equally long words: (start, end, the words that have a piece there, its ids)."""
        n, size = words.shape
        words = words + np.uint64(1)
        for start in range(size):
            h = np.zeros(n, np.uint64)
            for end in range(start + 1, min(start + PIECE_BYTES, size) + 1):
                h = (h ^ words[:, end - 1]) * MULT
                h ^= h >> np.uint64(29)
                key = h * MULT
                slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
                near = np.flatnonzero(self.taken[slot])
                at, key = self.first[slot[near]], key[near]
                ids = np.full(len(near), -1)
                for d in range(self.deepest):
                    same = np.flatnonzero(self.keys[np.minimum(at + d, len(self.ids))] == key)
                    ids[same] = self.ids[at[same] + d]
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    yield start, end, near[hit], ids[hit]


def words_of(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # \w also takes numerals that are no digits (superscripts, fractions, Roman and circled numerals): they part words.
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def chunks(word: str) -> list[bytes]:
    raw = (" " + word).encode("utf-8", "surrogatepass")
    return [raw[k : k + WORD_BYTES] for k in range(0, len(raw), WORD_BYTES)]


def by_length(items: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, byte matrix) for the items of each length."""
    size = np.fromiter(map(len, items), np.int64, len(items))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        m = np.frombuffer(b"".join([items[k] for k in at.tolist()]), np.uint8).reshape(len(at), n)
        yield at, np.asfortranarray(m).astype(np.uint64, order="F")


def forward(vocab: Vocabulary, prob: np.ndarray, words: np.ndarray, keep: bool = False):
    """Probability of each word under each language (``prob``: piece x language), summed over all segmentations."""
    n, size = words.shape
    alpha = np.zeros((size + 1, n, prob.shape[1]))
    alpha[0] = 1
    used = []
    for start, end, hit, ids in vocab.lookup(words):
        alpha[end, hit] += alpha[start, hit] * prob[ids]
        if keep:
            used.append((start, end, hit, ids))
    return (alpha, used) if keep else alpha[size]


def learn(vocab: Vocabulary, words: Counter, rounds: int = 3, seen: float = 0.05) -> np.ndarray:
    """Probability of every piece in the language of a sample's words; 0 for pieces that no word holds."""
    count: Counter = Counter()
    for w, n in words.items():
        for x in chunks(w):
            count[x] += n
    items = list(count)
    weight = np.array([count[x] for x in items], float)
    groups = list(by_length(items))
    p = np.full((len(vocab.pieces), 1), 1.0 / len(vocab.pieces))
    for _ in range(rounds):
        expected = np.zeros(len(vocab.pieces))
        for at, words in groups:
            alpha, used = forward(vocab, p, words, keep=True)
            beta = np.zeros_like(alpha)
            beta[-1] = 1
            for start, end, hit, ids in reversed(used):
                beta[start, hit] += beta[end, hit] * p[ids]
            total = alpha[-1, :, 0]
            scale = np.divide(weight[at], total, out=np.zeros(len(at)), where=total > 0)
            for start, end, hit, ids in used:
                share = alpha[start, hit, 0] * p[ids, 0] * beta[end, hit, 0] * scale[hit]
                expected += np.bincount(ids, share, len(expected))
        expected[vocab.single] += seen  # any text stays possible
        p = (expected / expected.sum())[:, None]
    return p[:, 0]


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = 300, sample_chars: int = 20_000) -> DataFrame:
    """lang and text (at most ``sample_chars`` characters) of ``sample_rows`` labelled rows of each language.

    Of the rows with letters that are short enough, those of smallest hash; of a language without such rows the
    shortest, by their first ``sample_chars`` characters. A threshold on the hash leaves about twice as many to order.
    """
    n = F.length(text)
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id) & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.substring(text, 1, sample_chars).alias("text"), n.alias("size"), F.xxhash64(doc_id, text).alias("h"))
    counts = rows.groupBy("lang").agg(F.count_if(F.col("size") <= sample_chars).alias("n")).collect()
    # One row a language.
    counts = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counts], "l string, n long")
    place = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(F.broadcast(counts), F.col("lang") == F.col("l"))
    rows = rows.where((F.col("n") == 0) | (F.col("size") <= sample_chars) & (place * F.col("n") < 2.0 * sample_rows)).select("lang", "text", "h", F.when(F.col("n") == 0, F.col("size")).otherwise(0).alias("size")).distinct()
    order = Window.partitionBy("lang").orderBy("size", "h")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_rows).select("lang", "text")


class Model:
    """Sparse tables of the piece probabilities: (language, ids, probabilities) in the languages' order."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.rows = sorted(rows, key=lambda r: r[0])
        self.langs = [r[0] for r in self.rows]

    def dense(self, vocab: Vocabulary, begin: int, end: int) -> np.ndarray:
        prob = np.zeros((len(vocab.pieces), min(end, len(self.rows)) - begin))
        for c, (_, ids, p) in enumerate(self.rows[begin:end]):
            prob[ids, c] = p
        return prob


def fit(texts: DataFrame, path: str | None = None) -> Model:
    """Every language of ``texts`` (lang, text), each learnt in a task of its own."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        words: Counter = Counter()
        for t in pdf["text"]:
            words.update(words_of(t))
        if not words:
            return pd.DataFrame({"lang": [], "ids": [], "p": []})
        p = learn(held("vocabulary", str(path), lambda: Vocabulary(path)), words)
        ids = np.flatnonzero(p).astype(np.int32)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "ids": [ids.tobytes()], "p": [p[ids].tobytes()]})

    found = texts.groupBy("lang").applyInPandas(one, "lang string, ids binary, p binary").toLocalIterator()
    return Model([(r["lang"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["p"])) for r in found])


class Part:
    """Some of the languages: log probabilities of words, kept from call to call."""

    def __init__(self, prob: np.ndarray, vocab: Vocabulary):
        self.prob, self.vocab = prob, vocab
        self.memo: dict[str, int] = {}
        self.logp = np.empty((0, prob.shape[1]))

    def _learn(self, words: list[str]) -> None:
        cut = [chunks(w) for w in words]
        flat = [x for xs in cut for x in xs]
        logp = np.empty((len(flat), self.prob.shape[1]))
        for at, m in by_length(flat):
            logp[at] = np.log(np.maximum(forward(self.vocab, self.prob, m), 1e-300))
        first = np.cumsum([0, *map(len, cut[:-1])])
        self.memo.update(zip(words, range(len(self.logp), len(self.logp) + len(words))))
        self.logp = np.vstack([self.logp, np.add.reduceat(logp, first)])

    def totals(self, words: list[list[str]]) -> np.ndarray:
        """Log probability of each text under each language."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.logp = {}, np.empty((0, self.prob.shape[1]))
        if new := set().union(*words).difference(self.memo):
            self._learn(sorted(new))
        get = self.memo.__getitem__
        return np.array([self.logp[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0) for ws in words])


class Scorer:
    """Languages are scored ``PART`` at a time; with more than that, a part's dense table is made for each call."""

    def __init__(self, model: Model, path: str | None = None):
        self.model, self.langs, self.vocab = model, model.langs, Vocabulary(path)
        self.only = Part(model.dense(self.vocab, 0, PART), self.vocab) if 0 < len(self.langs) <= PART else None

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) if t else [] for t in texts]
        lang, conf = [UND] * len(texts), [0.0] * len(texts)
        have = [k for k, ws in enumerate(words) if ws]
        if not self.langs or not have:
            return lang, conf
        parts = [self.only] if self.only else (Part(self.model.dense(self.vocab, k, k + PART), self.vocab) for k in range(0, len(self.langs), PART))
        totals = np.hstack([part.totals([words[k] for k in have]) for part in parts])
        for k, total in zip(have, totals):
            p = np.exp(total - total.max())
            best = int(p.argmax())
            lang[k], conf[k] = self.langs[best], float(p[best] / p.sum())
        return lang, conf


def predict(text: Column, spark: SparkSession, model: Model, path: str | None = None) -> Column:
    """struct(lang, score) of ``text`` under a fitted model."""
    shared, key = spark.sparkContext.broadcast(model.rows), fresh("m")

    @F.arrow_udf("lang string, score double")
    def lang_id(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = held("language", key, lambda: Scorer(Model(shared.value), path))
        for s in batches:
            lang, score = [], []
            for part in bpe.cut(s):
                a, b = scorer.score(part.to_pylist())
                lang += a
                score += b
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return lang_id(text)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", out: str = "language",
             path: str | None = None, **bounds) -> DataFrame:
    """``docs`` with a column ``out``: struct(lang, score)."""
    model = fit(sample(docs, text, lang, doc_id, **bounds), path)
    return docs.withColumn(out, predict(F.col(text), docs.sparkSession, model, path))
