"""Kneser-Ney scores, periodic runs and whitening against brute force, with everything odd in the rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pricelab.llm import kneserney, periodic, whitening

from .helpers import docs_frame, odd_docs

SF001 = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def discount(counts):
    n = collections.Counter(counts)
    out = {1: 0.5, 2: 1.0, 3: 1.5}
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        for r in (1, 2, 3):
            if n[r] and n[r + 1] and r - (r + 1) * y * n[r + 1] / n[r] > 0:
                out[r] = r - (r + 1) * y * n[r + 1] / n[r]
    return lambda c: out[min(c, 3)] if c else 0


class Slow:
    """Interpolated modified Kneser-Ney by dictionaries of words."""

    def __init__(self, texts, order):
        raw = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            ws = ["<s>"] * (order - 1) + tokens(t)
            for i in range(order - 1, len(ws)):
                for k in range(1, order + 1):
                    raw[k][tuple(ws[i - k + 1 : i + 1])] += 1
        self.raw, self.count, self.order = raw, [None] * (order + 1), order
        self.count[order] = dict(raw[order])
        for k in range(order - 1, 0, -1):
            kinds = collections.Counter(g[1:] for g in raw[k + 1])
            self.count[k] = {g: c if g[0] == "<s>" else kinds[g] for g, c in raw[k].items()}
        self.discount = [None] + [discount(self.count[k].values()) for k in range(1, order + 1)]
        self.behind = collections.defaultdict(list)
        for k in range(1, order + 1):
            for g, c in self.count[k].items():
                self.behind[g[:-1]].append((c, k))

    def p(self, gram):
        if not gram:
            return 1 / (len(self.raw[1]) + 1)
        rest = self.p(gram[1:])
        behind = self.behind.get(gram[:-1])
        if not behind:
            return rest
        k, total = len(gram), sum(c for c, _ in behind)
        c = self.count[k].get(gram, 0)
        return (c - self.discount[k](c)) / total + sum(self.discount[k](x) for x, _ in behind) / total * rest

    def score(self, text):
        ws = ["<s>"] * (self.order - 1) + tokens(text)
        grams = [tuple(ws[i - self.order + 1 : i + 1]) for i in range(self.order - 1, len(ws))]
        n, v = sum(self.raw[1].values()), len(self.raw[1])
        raw = [self.raw[1].get((g[-1],), 0) for g in grams]
        return len(grams), sum(c > 0 for c in raw), sum(math.log10((c + 1) / (n + v + 1)) for c in raw), sum(math.log10(self.p(g)) for g in grams)


def small_docs():
    return [r for r in odd_docs() if r[0] != 16] + [(200 + k, " ".join(random.Random(k).choices("the a of Cat dog runs on by Ä x".split(), k=k)), "en", "a") for k in range(40)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_equals_dictionaries(spark, order):
    rows = small_docs()
    learn = [r for r in rows if r[0] is None or r[0] % 3]
    model = kneserney.train(docs_frame(spark, learn), order=order, owner_share=60)
    slow = Slow([r[1] for r in learn], order)
    # the probabilities of any context add up to one
    words = [g[0] for g in slow.raw[1]] + ["unknown"]
    for context in (("the", "cat"), ("<s>", "<s>"), ("never", "seen")):
        assert abs(sum(slow.p((*context[3 - order :], w)) for w in words) - 1) < 1e-9
    docs = docs_frame(spark, rows)
    got = kneserney.score(docs, model, out="lm")
    assert got.columns == docs.columns + ["lm"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        want = slow.score(r["text"])
        assert (r["lm"]["n_tokens"], r["lm"]["n_known"]) == want[:2]
        assert r["lm"]["base_score"] == pytest.approx(want[2], abs=1e-8) and r["lm"]["score"] == pytest.approx(want[3], abs=1e-8)
        assert r["lm"]["perplexity"] == pytest.approx(10 ** (-want[3] / want[0]), rel=1e-8)
    assert kneserney.score(docs.limit(0), model).count() == 0


def test_kneser_ney_without_training(spark):
    docs = docs_frame(spark, [(1, "a b", None, None), (2, None, None, None)])
    model = kneserney.train(docs.limit(0))
    got = {r["doc_id"]: r["lm"] for r in kneserney.score(docs, model).collect()}
    assert model.tokens == 0 and got[1]["n_tokens"] == 3 and got[2]["n_tokens"] == 1
    assert got[1]["score"] == got[1]["base_score"] == 0 == got[1]["n_known"]


def test_kneser_ney_counts_beyond_a_byte(spark):
    rows = [(k, "to be " * 40, None, None) for k in range(30)]
    model = kneserney.train(docs_frame(spark, rows), order=2)
    slow = Slow([r[1] for r in rows], 2)
    got = kneserney.score(docs_frame(spark, [(1, "to be be or to", None, None)]), model).collect()[0]["lm"]
    assert got["score"] == pytest.approx(slow.score("to be be or to")[3], abs=1e-8)


def slow_runs(words, least, times):
    """Runs by comparing every word with the one each distance behind."""
    found, n = set(), len(words)
    for q in range(1, n // times + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            s = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - s >= max(least, times * q) and not any(q % d == 0 and all(words[i] == words[i + d] for i in range(s, k + q - d)) for d in range(1, q)):
                found.add((s, k + q - s, q))
    return sorted(found)


def test_runs_equal_brute_force(spark):
    rng = random.Random(3)
    for case in range(300):
        letters = "abc"[: 1 + case % 3]
        words = []
        while len(words) < rng.choice((5, 40, 90)):
            unit = rng.choices(letters, k=rng.randint(1, 9))
            words += unit * rng.randint(1, 8) + rng.choices(letters, k=rng.randint(0, 4))
        x = np.array([ord(w) for w in words])
        for least, times in ((24, 3), (6, 2), (10, 4)):
            assert periodic.runs_of(x, least, times) == slow_runs(words, least, times), (words, least, times)


def test_runs_of_odd_rows(spark):
    rows = odd_docs() + [(300, "x " * 5000, None, None), (301, "p q r " * 9 + "tail    ", None, None), (302, " ".join(map(str, range(3000))) + " go" * 24, None, None)]
    got = periodic.detect(docs_frame(spark, rows))
    assert got.count() == len(rows)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append((r["text"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) > 1000:
            continue
        runs = slow_runs(words, 24, 3)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert (text, runs, " ".join(w for k, w in enumerate(words) if k not in gone)) in by[i]
    assert by[300][0][1:] == ([(0, 5000, 1)], "x") and by[301][0][1] == [(0, 27, 3)]
    assert by[302][0][1] == [(3000, 24, 1)] and by[16][0][1] == [(0, 21000, 7)]
    assert periodic.detect(docs_frame(spark, rows).limit(0)).count() == 0


def test_runs_query_equals_brute_force(spark):
    import __spark_entry__ as E

    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = E.queries()["op12_periodic_runs"](spark, SF001).collect()
    assert len(got) == len(text) and sum(r["n_runs"] for r in got)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(words, 24, 3)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert tuple(r) == (r["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                            sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_eigenvalues_equal_library():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 40):
        for kind in range(4):
            x = rng.standard_normal((3 * d + 2, d)) * (10.0 ** rng.uniform(-3, 3, d) if kind == 1 else 1)
            if kind == 2:
                x[:, d // 2 :] = x[:, : d - d // 2]  # rank deficient
            v = x.T @ x
            if kind == 3:
                v = np.diag(np.repeat([4.0, 1.0], [d - d // 2, d // 2]))  # repeated eigenvalues
            want, axes = np.linalg.eigh(v)
            for s in rng.uniform(0, want[-1], 5):
                assert whitening.positive(v, s) == (want > s).sum()
            values, vectors = whitening.leading(v, 8)
            k = int((want[::-1][:8] > np.trace(v) * d * 2.0**-52).sum())
            assert len(values) == k and np.allclose(values, want[::-1][:k], rtol=0, atol=1e-13 * want[-1])
            assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-9
            assert np.abs(v @ vectors.T - vectors.T * values).max() <= 1e-12 * want[-1] * d


def slow_whitening(rows, most=8):
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in ok], np.int64)
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    out = {}
    for (i, _), row, c in zip(ok, x.tolist(), y):
        for k in range(min(most, len(values))):
            e = values[-1 - k]
            out[i, k + 1] = n, sum((n * a - int(b)) ** 2 for a, b in zip(row, s)), abs(c @ axes[:, -1 - k]) / math.sqrt(e), e / values.sum()
    return out


def same_whitening(got, want):
    assert len(got) == len(want)
    for r in got:
        n, deviation, value, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(value, abs=1e-7) and r["explained"] == pytest.approx(share, rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_query_equals_library(spark):
    import __spark_entry__ as E

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got = E.queries()["op13_whitening"](spark, SF001)
    assert got.columns == "vec_id component n deviation whitened explained identity_error".split()
    same_whitening(got.collect(), slow_whitening(rows))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.standard_normal(5) * [5, 4, 3, 2, 1]).tolist()) for k in range(200)] + [(900, [1.0, None, 2.0, 3.0, 4.0]), (901, None), (902, [float("nan")] + [0.0] * 4),
            (903, [float("inf")] * 5), (904, []), (905, [1.0, 2.0]), (906, [1e300] * 5)]
    frame = lambda rows: spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, whitened double, v string")
    docs = frame(rows)
    same_whitening(whitening.whiten(docs, whitening.fit(docs)).collect(), slow_whitening(rows[:200]))
    twice = frame(rows[:200] + rows[:200])
    got = whitening.whiten(twice, whitening.fit(twice))
    assert got.count() == 400 * 5 and got.first()["n"] == 400
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(frame(few), whitening.fit(frame(few))).collect() == []
    far = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 5.0])]
    got = whitening.whiten(frame(far), whitening.fit(frame(far))).collect()
    assert len(got) == 3 and {r["deviation"] for r in got if r["vec_id"] == 1} == {None}  # the second component is below the trace's rounding
