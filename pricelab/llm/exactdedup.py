"""Exact de-duplication by a Golomb-coded fingerprint exchange.

Texts are equal if they are the same bytes once every run of ASCII white space is one space.
The documents are packed into blocks with the sha256 of each normalised text;
the blocks exchange 64-bit fingerprints (``exchange.shared``), and only texts whose
fingerprint occurs twice are shuffled, one row for each different text of a
block, to be compared byte by byte (a grouping on the text itself). Of equal
texts the row with the smallest doc_id stays.

Null texts count as empty, and empty texts are equal. A null doc_id comes after
all others, so it stays only if its whole group has none. Rows that repeat a
doc_id and text share one decision and each count for the group's size;
``deduplicated`` keeps one row of each group, any one of those that share the
decision to stay. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, Block, pack, rows_of
from .common import one_each, stored
from .exchange import marked, shared, with_answers

#: Runs of white space other than one space; they become one space.
UNEVEN = re.compile(rb" *[\x09-\x0D][\x20\x09-\x0D]*| {2,}")


def normalised(text: bytes) -> bytes:
    return UNEVEN.sub(b" ", text)


def _digests(b: Block) -> dict[str, bytes]:
    return {"shas": b"".join(hashlib.sha256(normalised(b.text(k))).digest() for k in range(len(b.ids)))}


def _prints(shas: bytes) -> np.ndarray:
    return np.frombuffer(shas, ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)


def decide(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    blocks = pack(docs, text, doc_id, block_bytes, _digests, "shas binary")

    rows = blocks.agg(F.sum(F.octet_length("ids"))).collect()[0][0] or 0
    answers = shared(blocks.select("block", "shas"), lambda row: np.unique(_prints(row["shas"])), rows // 8)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                b, fp = Block(row["ids"], row["sizes"], row["data"]), _prints(row["shas"])
                uniq, inv, count = np.unique(fp, return_inverse=True, return_counts=True)
                often = count > 1
                if row["answer"]:
                    often |= marked(row["answer"])
                found: dict[tuple[bytes, bytes], list[int]] = {}
                for k in np.flatnonzero(often[inv]).tolist():
                    key = row["shas"][32 * k : 32 * k + 32], normalised(b.text(k))
                    found.setdefault(key, []).append(int(b.ids[k]))
                if found:
                    yield pa.record_batch([pa.array([s for s, _ in found], pa.binary()), pa.array([t for _, t in found], pa.binary()),
                                           pa.array([min(i) for i in found.values()], pa.int64()), pa.array([len(i) for i in found.values()], pa.int64())],
                                          names=["sha", "text", "keep", "n"])

    texts = with_answers(blocks, answers).select("ids", "sizes", "data", "shas", "answer").mapInArrow(suspects, "sha binary, text binary, keep long, n long")
    groups = texts.groupBy("sha", "text").agg(F.min("keep").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    # A table of its own: a join of two plain exchanges, whose hot group Spark splits.
    groups = stored(groups.select(F.col("sha").alias("g"), "keep", "n"), "copies")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, shas in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.record_batch([pa.array(np.frombuffer(ids, np.int64)), pa.array([shas[k : k + 32] for k in range(0, len(shas), 32)], pa.binary())], names=["id", "sha"])

    out = blocks.select("ids", "shas").mapInArrow(each, "id long, sha binary").join(groups, F.col("sha") == F.col("g"), "left")
    keep = F.coalesce("keep", "id")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.nullif(keep, F.lit(NO_ID)).alias("keep_id"),
                      F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("id") == keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one of every group of equal texts."""

    @F.pandas_udf("string")
    def text_sha256(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([hashlib.sha256(normalised(x)).hexdigest() for x in s], dtype=object)

    no_id = F.lit(NO_ID)
    decided = decide(docs, text, doc_id).select(F.coalesce("doc_id", no_id).alias("id"), F.col("text_sha256").alias("key"),
                                                F.equal_null("doc_id", "keep_id").alias("kept"))
    return one_each(docs, F.coalesce(F.col(doc_id).cast("long"), no_id), text_sha256(F.coalesce(F.col(text), F.lit("")).cast("binary")), decided)
