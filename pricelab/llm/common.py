"""Small shared helpers: the learning split, scratch tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare_session, scratch_path

#: ASCII white space, as the contracts write it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str, folds: int = 4) -> Column:
    """True for the fold that no model learns from: crc32(doc_id as text) mod ``folds`` is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 2, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (cuts lineage; survives lost executors)."""
    spark = df.sparkSession
    prepare_session(spark)
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:6]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_each(docs: DataFrame, id: Column, key: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, by ``decided`` (id, key, kept), one row for each of theirs; of rows alike in
    id and key any one stays.

    Only keys that go or occur twice are joined, so a table without copies is not joined with itself.
    """
    i, k, r = fresh("i"), fresh("k"), fresh("r")
    groups = decided.groupBy("id", "key").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    groups = stored(groups.select(F.col("id").alias(i + "g"), F.col("key").alias(k + "g"), "kept"), "decisions")
    rows = docs.withColumns({i: id, k: key})
    same = lambda g: (F.col(i) == g[i + "g"]) & (F.col(k) == g[k + "g"])
    stay, repeated = rows.join(groups, same(groups), "left_anti").select(docs.columns), groups.where("kept")
    if repeated.isEmpty():
        return stay
    some = rows.join(repeated, same(repeated), "left_semi").groupBy(i, k).agg(F.first(F.struct(*docs.columns)).alias(r))
    return stay.union(some.select(*[F.col(r).getField(c).alias(c) for c in docs.columns]))


_HELD: dict = {}


def held(kind: str, key: str, make: Callable):
    """A Python worker's one large object (a codec or a model with its memo).

    Workers live on from stage to stage, so what one operator keeps would lie beside the next one's: another kind or
    key puts the last one out.
    """
    if (kind, key) not in _HELD:
        let_go()
        _HELD[kind, key] = make()
    return _HELD[kind, key]


def let_go() -> None:
    """What a worker holds from an earlier operator goes, for work that needs the space and holds nothing itself.

    Freed memory goes back to the system: the allocator would keep it, and the next model would come on top.
    """
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def fresh(prefix: str = "_c") -> str:
    """A column name that no input has."""
    return f"{prefix}_{uuid.uuid4().hex[:10]}"
