"""Corpus runs with a crash-consistent manifest: resume, overwrite or abort.

A run writes its tickers in parts, each into a folder of its own; when a part's data is written, one small
manifest file names the part with, for each ticker, how many prompts it has and their digest. Only what a
manifest names is read, so a run killed at any point leaves whole parts and ignored ones, and a run with the same or another
cut goes on with the tickers that no manifest names.

    path/data/part=<run>-<k>/ticker=<T>/*.json     prompts
    path/manifest/<run>-<k>/*.parquet              ticker, prompts, digest, part, started

* ``resume``: tickers that the manifest names are left out;
* ``overwrite``: all tickers are written anew; parts of earlier starts count no more once the new run's first part is there;
* ``abort``: an error if there is a corpus.

A folder of JSON lines without a manifest is read by its lines: the tickers are those of their ``STOCK:`` tags.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stock_tag

MANIFEST_SCHEMA = "ticker string, prompts bigint, digest string, part string, started bigint"
PROMPT_SCHEMA = "i long, pred_days long, context_days long, text string, ticker string, part string"
MODES = ("resume", "overwrite", "abort")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows that count: those of the latest overwriting start and of all after it."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").parquet(os.path.join(path, "manifest"))
        rows = rows.where(F.col("started") >= rows.select(F.max(F.when(F.col("ticker").isNull(), F.col("started")))).scalar())
        return rows.where(F.col("ticker").isNotNull())
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """The prompts of every part that a manifest names."""
    names = manifest(spark, path).select("part", "ticker")
    try:
        rows = spark.read.schema(PROMPT_SCHEMA).option("basePath", os.path.join(path, "data")).json(os.path.join(path, "data"))
    except AnalysisException:
        return spark.createDataFrame([], PROMPT_SCHEMA)
    return rows.join(names, ["part", "ticker"], "left_semi")


def done_tickers(spark: SparkSession, path: str) -> DataFrame:
    """The tickers that need no more work: by the manifest, or by the tags of a folder of plain JSON lines."""
    rows = manifest(spark, path)
    if rows.isEmpty():
        try:
            lines = spark.read.schema("text string").option("recursiveFileLookup", "true").json(path)
            return lines.select(stock_tag("text").alias("ticker")).where(F.col("ticker").isNotNull()).distinct()
        except AnalysisException:
            pass
    return rows.select("ticker").distinct()


def digests(rows: DataFrame, *keys: str) -> DataFrame:
    """Prompts and a digest of them for each key: the sum of the prompts' hashes, whatever their order."""
    one = F.conv(F.substring(F.md5(F.concat_ws("|", "i", "text")), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*keys).agg(F.count("*").alias("prompts"), F.sum(one).cast("string").alias("digest"))


def run(universe: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, mode: str = "resume", parts: int = 8,
        after_part: Callable[[int], None] | None = None) -> str:
    """Write the corpus of ``universe`` (a column ``ticker``) below ``path``; returns the run's name.

    ``build`` gives the prompts of some tickers. ``after_part`` is called behind every commit.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    spark, name = universe.sparkSession, uuid.uuid4().hex[:12]
    done = done_tickers(spark, path)
    if mode == "abort" and not done.isEmpty():
        raise FileExistsError(f"there is a corpus in {path}")
    left = universe.select("ticker").distinct()
    starts = _starts(spark, path)
    if mode == "resume":
        left = left.join(done, "ticker", "left_anti")
    started = (max(starts) if starts else 0) + (0 if mode == "resume" and starts else 1)
    for k in range(parts):
        part, some = f"{name}-{k}", left.where(F.pmod(F.xxhash64("ticker"), F.lit(parts)) == k)
        data = os.path.join(path, "data", f"part={part}")
        build(some).write.mode("overwrite").partitionBy("ticker").json(data)
        try:
            written = spark.read.schema("i long, text string, ticker string").option("basePath", data).json(data)
        except AnalysisException:  # no ticker of the part has a prompt
            written = spark.createDataFrame([], "i long, text string, ticker string")
        # tickers without a prompt are done as well; a row without ticker marks the start
        rows = some.join(digests(written, "ticker"), "ticker", "left").select("ticker", F.coalesce("prompts", F.lit(0)).alias("prompts"), F.coalesce("digest", F.lit("0")).alias("digest"))
        mark = spark.createDataFrame([(None, 0, "0")], "ticker string, prompts bigint, digest string") if started not in starts else None
        rows = rows.unionByName(mark) if mark is not None else rows
        starts.add(started)
        rows.withColumn("part", F.lit(part)).withColumn("started", F.lit(started).cast("bigint")).coalesce(1).write.parquet(os.path.join(path, "manifest", part))
        if after_part:
            after_part(k)
    return name


def _starts(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the starts that the manifest marks (one row each)."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").parquet(os.path.join(path, "manifest"))
        return {r["started"] for r in rows.where(F.col("ticker").isNull()).select("started").distinct().collect()}
    except AnalysisException:
        return set()


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Tickers whose prompts are not those that the manifest says (ticker, part)."""
    found = digests(corpus(spark, path), "part", "ticker").withColumnsRenamed({"prompts": "p", "digest": "d"})
    rows = manifest(spark, path).join(found, ["part", "ticker"], "left")
    return rows.where((F.coalesce("p", F.lit(0)) != F.col("prompts")) | (F.coalesce("d", F.lit("0")) != F.col("digest"))).select("ticker", "part")
