"""Golomb-coded fingerprint exchange: which of a block's fingerprints occur in another block?

Every block sends the sorted fingerprints of a range to the range's owner, as
the Golomb-Rice code of their gaps: about log2(mean gap) + 1.5 bits each. The owner
decodes all lists, marks what occurs more than once, and returns to each block
one bit for each fingerprint that it sent. A fingerprint costs a block the same
however often the block holds it, so a fingerprint that is everywhere is one
entry a block, and the owners' ranges stay even.

Fingerprints are cut to ``bits`` bits on the way. Equal ones always come back marked;
a few different ones may (about n / 2**bits of them), so callers verify.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import rows_of
from .common import let_go

OWNER_SHARE = 1_000_000  # fingerprints an owner


def rice_encode(values: np.ndarray, base: int) -> tuple[int, bytes]:
    """(k, code) of sorted uint64 values >= base: low k bits of each gap, then the rest in unary."""
    gaps = np.diff(values, prepend=np.uint64(base))
    k = max(0, int(np.log2(max(1.0, 0.69 * float(gaps.mean())))))
    whole, part = divmod(k, 8)
    low = np.ascontiguousarray(gaps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :whole]
    middle = ((gaps >> np.uint64(8 * whole))[:, None] >> np.arange(part, dtype=np.uint64)) & np.uint64(1)
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    return k, low.tobytes() + np.packbits(middle.astype(np.uint8).ravel()).tobytes() + np.packbits(unary).tobytes()


def rice_decode(code: bytes, n: int, k: int, base: int) -> np.ndarray:
    whole, part = divmod(k, 8)
    raw = np.frombuffer(code, np.uint8)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :whole] = raw[: n * whole].reshape(n, whole)
    gaps = gaps.view("<u8").ravel().astype(np.uint64)
    at = n * whole
    if part:
        end = at + -(-n * part // 8)
        middle = np.unpackbits(raw[at:end], count=n * part).reshape(n, part)
        for j in range(part):
            gaps |= middle[:, j].astype(np.uint64) << np.uint64(8 * whole + j)
        at = end
    stops = np.flatnonzero(np.unpackbits(raw[at:]))[:n]
    gaps |= (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def owner_bounds(owners: int, bits: int) -> np.ndarray:
    return np.array([-(-(k << bits) // owners) for k in range(owners)], np.uint64)


def shared(blocks: DataFrame, prints: Callable[[dict], np.ndarray], total: int, bits: int = 40, owner_share: int = OWNER_SHARE, hot: int = 1 << 30) -> DataFrame:
    """(block, answer): one row a block with one entry (owner, n, bits, hot) for each list that it sent, in order.

    ``bits`` marks the fingerprints of more than one list, ``hot`` those of ``hot`` lists or more.

    ``prints`` gives a block's distinct uint64 fingerprints, sorted, from its row; it runs in the task that encodes
    them, so there is one Python worker a task. ``total``: about how many there are in all.
    """
    owners = max(1, ceil(total / owner_share))
    bits = max(bits, min(63, int(np.log2(total + 1)) + 22))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        low = owner_bounds(owners, bits)
        for batch in batches:
            for row in rows_of(batch):
                block, v = row["block"], prints(row) >> np.uint64(64 - bits)
                cut = np.append(np.searchsorted(v, low), len(v))
                out = []
                for owner in np.flatnonzero(np.diff(cut)).tolist():
                    part = v[cut[owner] : cut[owner + 1]]
                    out.append((owner, block, len(part), *rice_encode(part, int(low[owner]))))
                if out:
                    cols = list(zip(*out))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                          names=["owner", "block", "n", "k", "code"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(owner_bounds(owners, bits)[pdf["owner"].iloc[0]])
        v = np.concatenate([rice_decode(c, n, k, low) for c, n, k in zip(pdf["code"], pdf["n"], pdf["k"])])
        order = np.argsort(v)
        same = np.diff(v[order]) == 0
        mark = np.zeros(len(v), np.uint8)
        mark[order[1:][same]] = 1
        mark[order[:-1][same]] = 1
        first = np.flatnonzero(np.r_[True, ~same])
        often = np.diff(np.append(first, len(v)))
        many = np.zeros(len(v), np.uint8)
        many[order] = np.repeat(often >= hot, often)
        ends = np.cumsum(pdf["n"].to_numpy())
        cut = [slice(e - n, e) for e, n in zip(ends, pdf["n"])]
        return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "n": pdf["n"], "bits": [np.packbits(mark[c]).tobytes() for c in cut],
                             "hot": [np.packbits(many[c]).tobytes() if many[c].any() else None for c in cut]})

    lists = blocks.mapInArrow(send, "owner int, block long, n int, k int, code binary")
    marks = lists.groupBy("owner").applyInPandas(answer, "block long, owner int, n int, bits binary, hot binary")
    return marks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("owner", "n", "bits", "hot"))).alias("answer"))


def marked(answer, field: str = "bits") -> np.ndarray:
    """One boolean for each fingerprint of the block, in their order."""
    parts = [np.unpackbits(np.frombuffer(a[field], np.uint8), count=a["n"]) if a[field] else np.zeros(a["n"], np.uint8) for a in answer or ()]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def with_answers(blocks: DataFrame, answers: DataFrame, name: str = "answer") -> DataFrame:
    """Each block with its answer; the small side is hashed, the blocks are not sorted."""
    answers = answers.select(F.col("block").alias("to_block"), F.col("answer").alias(name)).hint("shuffle_hash")
    return blocks.join(answers, F.col("block") == F.col("to_block"), "left").drop("to_block")
