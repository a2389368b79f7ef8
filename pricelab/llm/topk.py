"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's dimensions are its terms. Candidates are dealt by hash of the id into
chunks, as few as their size and the cores ask for, since every chunk gets all
queries: through the shuffle, never by a broadcast, which the driver would have
to hold. A task keeps its chunk as blocks of candidates and lets blocks of
queries stream past. For one pair of blocks the queries' sparse rows are walked
term by term: each term scatters query weight times its posting list, the
candidates' values of that dimension, into a dense score array (query x
candidate) of a few queries at a time. ``partition`` selects the k best of a
block, a chunk keeps its k best of a query and a distributed merge those of all
chunks. Arithmetic is exact, in integers as wide as the largest possible sum.

Vectors that are null or hold null or non-finite components take no part.
Vectors of another length than the query are scored over the dimensions that
both have. Ties go to the smaller id; a repeated id is a candidate as often as
it occurs, but never its own, and asks once, with the smallest of its vectors; a
query gets all if there are fewer than k.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go

QUERY_BLOCK, CANDIDATE_BLOCK = 256, 4096
#: Queries that take a term together: their scores for a block of candidates stay in a core's cache.
TOGETHER = 8
#: 64 MB of 64-bit integers in a task; chunks for a core where there are rows for as many blocks.
CHUNK_VALUES, CHUNKS_A_CORE = 1 << 23, 3


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale * component); rows that take no part are left out."""
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True)))
    wide = F.raise_error(F.lit("a component beyond 64 bits once scaled")).cast("long")
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < float(1 << 63), F.floor(c * scale)).otherwise(wide))
    return ok.select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Term x row values (zero where a vector is shorter)."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    m = np.zeros((sizes.max(initial=0), len(sizes)), np.int64)
    m[np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)] = values
    return m


def kind(q: np.ndarray, c: np.ndarray) -> type:
    """Of integers that hold the values and any sum on the way; ``object`` has no bounds."""
    most = [np.abs(m.astype(float)).max(1, initial=0) for m in (q, c)]
    total = sum(a * b for a, b in zip(*most))
    if total < 1 << 30 and all(m.max(initial=0) < 1 << 30 for m in most):
        return np.int32
    return np.int64 if total < 1 << 62 else object


def best(qid: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score): the k best of all ``blocks`` (ids, matrix) for each query."""
    top = [(np.empty(0, np.int64),) * 2 for _ in qid]
    for cid, c in blocks:
        held = kind(q, c)
        weights, postings = q[: len(c)].astype(held), c.astype(held)
        for row, query in enumerate(qid):
            if row % TOGETHER == 0:
                some = weights[:, row : row + TOGETHER]
                dense = np.zeros((some.shape[1], len(cid)), held)
                for term in np.flatnonzero(some.any(1)):
                    asks = np.flatnonzero(some[term])
                    if len(asks) == len(dense):
                        dense += some[term][:, None] * postings[term]
                    else:
                        dense[asks] += some[term][asks, None] * postings[term]
            score = dense[row % TOGETHER]
            ids, scores = top[row]
            ok = cid != query
            if len(ids) == k:
                ok &= score >= scores[-1]
            ok = np.flatnonzero(ok)
            if len(ok) > k:
                kth = np.partition(score[ok], len(ok) - k)[len(ok) - k]
                ok = ok[score[ok] >= kth]  # with all ties at the border
            if len(ok):
                ids, scores = np.r_[ids, cid[ok]], np.r_[scores, score[ok].astype(np.int64)]
                order = np.lexsort((ids, -scores))[:k]
                top[row] = ids[order], scores[order]
    ids, scores = (np.concatenate([np.empty(0, np.int64), *x]) for x in ([t[0] for t in top], [t[1] for t in top]))
    return np.repeat(qid, [len(t[0]) for t in top]), ids, scores


def dealt(df: DataFrame, vector: str) -> int:
    """How many chunks: none of more than CHUNK_VALUES values, and some for each core if there are enough rows."""
    n, values = df.agg(F.count("*"), F.sum(F.array_size(vector))).collect()[0]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, ceil((values or 0) / CHUNK_VALUES), min(ceil(n / CANDIDATE_BLOCK), CHUNKS_A_CORE * cores))


def search(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates (all other rows) of every query row."""
    chunks = dealt(df, vector)
    rows = quantised(df, vec_id, vector, scale).select(F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(False).alias("asks"), "id", "v")
    queries = quantised(df.where(is_query), vec_id, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(True).alias("asks"), "id", "v")
    both = rows.union(queries).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "asks")

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        now, blocks = None, []
        for batch in batches:
            chunk, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "asks", "id"))
            ends = [*(np.flatnonzero((np.diff(chunk) != 0) | (asks[1:] != asks[:-1])) + 1), len(ids)]
            for start, end in zip([0, *ends], ends):
                if start < end and chunk[start] != now:
                    now, blocks = chunk[start], []
                size = QUERY_BLOCK if start < end and asks[start] else CANDIDATE_BLOCK
                for at in range(start, end, size):
                    some = slice(at, min(at + size, end))
                    vectors = matrix(batch.column("v").slice(at, some.stop - at))
                    if asks[start]:
                        yield pa.record_batch([pa.array(x) for x in best(ids[some], vectors, blocks, k)], names=["query_id", "vec_id", "score"])
                    else:
                        blocks.append((ids[some].copy(), vectors))

    found = both.mapInArrow(accumulate, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
