"""Documents packed into blocks of some megabytes, written once to the shared folder.

A block is one row: ``block`` (its number), ``ids`` (int64 each), ``sizes`` (bytes
of each text, int64) and ``data`` (the UTF-8 texts end to end, zstd). The table
fixes which documents a block holds, so an answer can be sent back to a block
even if an executor is lost between. Texts are never split; a text above the
block size is a block of its own. Null texts count as empty; a null id is kept
as ``NO_ID``, the largest int64, so it sorts last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, stored

NO_ID = (1 << 63) - 1
SLICE_ROWS = 500  # rows of a batch that are copied at a time
SCHEMA = "block long, ids binary, sizes binary, data binary"


class Block:
    """The documents of one row of a table of blocks."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes | None):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.raw = b""
        if data is not None and len(self.ends) and self.ends[-1]:
            self.raw = pa.Codec("zstd").decompress(data, int(self.ends[-1]), asbytes=True)

    def bytes(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8)

    def text(self, k: int) -> bytes:
        return self.raw[self.starts[k] : self.ends[k]]

    def doc_of(self) -> np.ndarray:
        """Document of each byte."""
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time as Python objects: a batch may hold tens of blocks."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


Extra = Callable[[Block], dict[str, bytes]]


def _emit(parts: list[tuple[np.ndarray, np.ndarray, bytes]], number: int, extra: Extra | None) -> pa.RecordBatch:
    ids, sizes = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (0, 1))
    raw = b"".join(p[2] for p in parts)
    row = {"block": pa.array([number], pa.int64()), "ids": [ids.tobytes()], "sizes": [sizes.tobytes()],
           "data": [pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)]}
    if extra:
        b = Block(row["ids"][0], row["sizes"][0], None)
        b.raw = raw
        row |= {k: [v] for k, v in extra(b).items()}
    return pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v, pa.binary()) for k, v in row.items()})


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 1 << 20, extra: Extra | None = None,
         extra_schema: str = "") -> DataFrame:
    """A stored table of blocks; ``extra`` adds binary columns made from a block."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        number, parts, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], 0
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            col = batch.column(1).cast(pa.large_binary())
            sizes = pc.binary_length(col).to_numpy(zero_copy_only=False)
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            data, at = col.buffers()[2], 0
            while at < len(ids):
                room = np.searchsorted(np.cumsum(sizes[at:]), block_bytes - size, side="right")
                end = min(len(ids), at + max(int(room), 0 if parts else 1))
                if end > at:
                    raw = data.slice(offsets[at], offsets[end] - offsets[at]).to_pybytes() if data is not None else b""
                    parts.append((ids[at:end], sizes[at:end], raw))
                    size += len(raw)
                    at = end
                if at < len(ids):
                    yield _emit(parts, number, extra)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield _emit(parts, number, extra)

    return stored(rows.mapInArrow(to_blocks, SCHEMA + (", " + extra_schema if extra_schema else "")), "blocks")


def raw_bytes(blocks: DataFrame) -> int:
    """Bytes of text in a table of blocks."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(np.frombuffer(x, np.int64).sum()) for b in batches for x in b.column(0).to_pylist())
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    return blocks.select("sizes").mapInArrow(total, "n long").agg(F.sum("n")).collect()[0][0] or 0
