"""Whitening of embeddings: spectrum slicing for the leading components of their covariance.

The components of a vector become x = floor(scale * c) + shift, exact integers. Two passes over all rows fit the model: the
number and the sums of the vectors, then the products of the vectors less the rounded mean, added up a matrix row
at a time (each task sends one partial matrix, in rows). The mean's rest is taken out of the sum exactly, so nothing large cancels.

The covariance, a matrix of dimension x dimension, is sliced on the driver. The symmetric factorisation L D L^T of
V - s I has as many positive pivots as V has eigenvalues above s (inertia), whatever s: halving intervals
by such counts isolates each leading eigenvalue; Rayleigh quotient iteration from there converges cubically to
its vector; and counts on both sides of the value found certify its number. A value that another interval's number
belongs to is refused and the interval halved further. Eigenvalues that no
interval of double precision separates share one, and their vectors are taken orthogonal to each other.

Then each row is projected, and one more pass gives the covariance of what came out.

Rows whose vector is null or empty, or holds null or non-finite entries or ones beyond 2**62 when scaled, take no part
and give no rows. Of vectors of different lengths those of the most frequent length (of equals the shorter) take part.
Components of no variance (below dimension * 2**-52 of the trace) are left out: one row, or equal rows, give none.
A deviation beyond a long is null. Repeated rows count and return each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST = float(1 << 62)
ROWS = 2_000  # vectors that are turned into numbers at a time
GROWTH = (1 + 17**0.5) / 8  # of the pivoting by one or two rows


def vectors(batches: Iterator[pa.RecordBatch], at: int, scale: int, shift: int) -> Iterator[tuple[pa.RecordBatch, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """Some rows, and by length the places and the integer vectors of those that take part."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            col = part.column(at).cast(pa.list_(pa.float64()))
            flat = col.flatten()  # without what null rows hold
            value = flat.to_numpy(zero_copy_only=False)  # null is nan
            size = np.array([-1 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()], np.int64)
            end = np.cumsum(np.maximum(size, 0))
            with np.errstate(all="ignore"):
                scaled = np.floor(scale * value)
                bad = np.r_[0, np.cumsum(~(np.abs(scaled) < LARGEST))]
            ok = (size > 0) & (bad[end] == bad[end - np.maximum(size, 0)])
            out = {}
            for d in np.unique(size[ok]).tolist():
                rows = np.flatnonzero(ok & (size == d))
                out[d] = rows, scaled[(end[rows] - d)[:, None] + np.arange(d)].astype(np.int64) + shift
            yield part, out


def positive(a: np.ndarray, s: float) -> int:
    """Eigenvalues of ``a`` above ``s``: the positive pivots of L D L^T of a - s I, by one row or two at a time."""
    a = a - s * np.eye(len(a))
    count = 0
    while len(a):
        down = np.abs(a[1:, 0])
        most = down.max(initial=0.0)
        two = False
        if abs(a[0, 0]) < GROWTH * most:
            r = 1 + int(down.argmax())
            other = np.abs(a[r])
            other[r] = 0
            if abs(a[0, 0]) * other.max() < GROWTH * most * most:
                if abs(a[r, r]) >= GROWTH * other.max():
                    swap, to = r, 0
                else:
                    swap, to, two = r, 1, True
                a[[to, swap]] = a[[swap, to]]
                a[:, [to, swap]] = a[:, [swap, to]]
        if two:  # one positive and one negative pivot
            count += 1
            rest = a[2:, :2]
            a = a[2:, 2:] - rest @ np.linalg.solve(a[:2, :2], rest.T)
        else:
            count += a[0, 0] > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0] / a[0, 0]) if a[0, 0] else a[1:, 1:]
    return int(count)


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are not zero, falling, and their unit vectors (a row each)."""
    v = (v + v.T) / 2
    d = len(v)
    top = float(np.abs(v).sum(1).max(initial=0.0))  # no eigenvalue is beyond
    least = max(np.trace(v), 0.0) * d * 2.0**-52
    if not top or not least:
        return np.empty(0), np.empty((0, d))
    want = min(most, positive(v, least))
    values: list[float] = []
    found = np.empty((0, d))
    rng = np.random.default_rng(0)
    known = {least: positive(v, least), top * (1 + 2.0**-40): 0}

    def above(s: float) -> int:
        if s not in known:
            known[s] = positive(v, s)
        return known[s]

    for k in range(1, want + 1):  # the k-th: count above low >= k > count above high
        low = max(s for s, n in known.items() if n >= k)
        high = min(s for s, n in known.items() if n < k)
        while True:
            alone = above(low) == k and above(high) == k - 1
            narrow = high - low <= 4 * np.spacing(high)
            if alone or narrow:
                x = rng.standard_normal(d)
                value, x = iterate(v, x, (low + high) / 2, found)
                wide = 8 * d * np.spacing(top)
                inside = low - wide <= value <= high + wide
                if inside and above(value - wide) >= k and above(value + wide) < k or narrow:
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        values.append(value)
        found = np.vstack([found, x])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], found[order]


def iterate(v: np.ndarray, x: np.ndarray, shift: float, beside: np.ndarray) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration, orthogonal to the vectors ``beside``, after two steps at the fixed shift."""

    def step(x: np.ndarray, s: float) -> np.ndarray:
        a = v - s * np.eye(len(v))
        try:
            y = np.linalg.solve(a, x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(a + np.spacing(np.abs(v).max()) * np.eye(len(v)), x)
        for _ in range(2):
            y = y - beside.T @ (beside @ y)
        return y / np.linalg.norm(y)

    x = step(step(step(x, shift), shift), shift)
    value = x @ v @ x
    rest = np.inf
    for _ in range(12):
        new = step(x, value)
        left = float(np.linalg.norm(v @ new - (new @ v @ new) * new))
        if left >= rest:
            break
        x, rest, value = new, left, new @ v @ new
    return float(value), x


@dataclass
class Whitening:
    """A fitted model: the vectors' number and sums (exact), leading eigenvalues and vectors, the share of each."""

    scale: int
    shift: int
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([float(Fraction(s, self.n)) for s in self.sums])) @ (self.axes / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n * x - sum)**2, null if it is no long."""
        apart = [abs(self.n * int(e) - s) for col, s in zip(x.T, self.sums) for e in (col.min(), col.max())] if len(x) else [0]
        if max(apart) ** 2 * len(self.sums) < 1 << 62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = (sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist())
        return [e if e < 1 << 63 else None for e in exact]


def _added(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum over all tasks of the matrix that ``make`` gives for a task's rows, added up by matrix row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = make(batches)
        if total is not None:
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(total)), width)), pa.array(np.tile(np.arange(width), len(total))), pa.array(total.ravel())],
                                  names=["i", "j", "value"])

    got = rows.mapInArrow(partial, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((1 + max((r["i"] for r in got), default=0), width))
    for r in got:
        out[r["i"], r["j"]] = r["value"]
    return out


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """Fitted to all rows; None if no row takes part."""
    rows = rows.select(F.col(vector).cast("array<double>").alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # by length: rows, sums of the high and of the low 31 bits
        for _, some in vectors(batches, 0, scale, shift):
            for d, (at, x) in some.items():
                n, high, low = total.get(d, (0, np.zeros(d, np.int64), np.zeros(d, np.int64)))
                total[d] = n + len(at), high + (x >> 31).sum(0), low + (x & ((1 << 31) - 1)).sum(0)
        for d, (n, high, low) in total.items():
            yield pa.record_batch([pa.array([d] * (d + 1)), pa.array(np.arange(-1, d)), pa.array(np.r_[0, high]), pa.array(np.r_[n, low])], names=["d", "j", "high", "low"])

    parts = rows.mapInArrow(sums, "d long, j long, high long, low long").groupBy("d", "j")
    parts = parts.agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    # Of the lengths only the most frequent one's sums come to the driver: a row for each dimension.
    first = parts.where("j = -1").orderBy(F.desc("low"), "d").limit(1).collect()
    if not first:
        return None
    d, n = first[0]["d"], int(first[0]["low"])
    total = [int(r["high"]) * (1 << 31) + int(r["low"]) for r in parts.where((F.col("d") == d) & (F.col("j") >= 0)).orderBy("j").collect()]
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for _, some in vectors(batches, 0, scale, shift):
            if d in some:
                y = (some[d][1] - middle).astype(np.float64)
                out = y.T @ y + (0 if out is None else out)
        return out

    rest = np.array([float(Fraction(s, n) - int(m)) for s, m in zip(total, middle)])
    v = _added(rows, products, d) / n - np.outer(rest, rest)
    values, axes = leading(v, components)
    model = Whitening(scale, shift, n, total, values, axes, values / np.trace(v) if len(values) else values)
    if not len(values):
        return model

    def white(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        """Sums of the whitened values (last row) and of their products."""
        out = None
        for _, some in vectors(batches, 0, scale, shift):
            if d in some:
                w = model.project(some[d][1])
                out = np.vstack([w.T @ w, w.sum(0)]) + (0 if out is None else out)
        return out

    got = _added(rows, white, len(values)) / n
    model.identity_error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(len(values))).max())
    return model


def whiten(rows: DataFrame, model: Whitening | None, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([rows.schema.fields[0], *T._parse_datatype_string(out).fields])
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in vectors(batches, 1, model.scale, model.shift):
            if d in some:
                at, x = some[d]
                n = len(at) * k
                yield pa.record_batch([part.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(n, model.n)),
                                       pa.array([e for e in model.deviation(x) for _ in range(k)], pa.int64()), pa.array(model.project(x).ravel()),
                                       pa.array(np.tile(model.explained, len(at))), pa.array(np.full(n, model.identity_error))], names=schema.names)

    return rows.mapInArrow(run, schema)
