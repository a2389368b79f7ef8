"""Shuffled training shards: JSON lines in a global random order, with an index to seek by.

A corpus is sorted by its shuffle key (``corpus.split_corpus``) over all tasks, its rows numbered, and every
``shard_rows`` of them are one file, so all shards but the last hold the same number of lines. The index
holds the byte at which each line begins: a trainer opens a shard and reads any line, or goes on after the last one that it has seen.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered

INDEX_SCHEMA = "shard bigint, line int, begin bigint, size int, pos bigint"


def write_shards(rows: DataFrame, path: str, shard_rows: int = 100_000, order: tuple[str, ...] = ("order_key", "ticker", "i"),
                 columns: tuple[str, ...] = ("text",)) -> None:
    """``path/shards/shard=N/`` (one text file each) and ``path/index`` (Parquet, by shard)."""
    lines = numbered(rows, *order).withColumn("value", F.to_json(F.struct(*columns)))
    lines = lines.select((F.col("pos") / shard_rows).cast("bigint").alias("shard"), "pos", "value")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a shard's rows lie in one task, in order: one file
    files = lines.repartition(width, "shard").sortWithinPartitions("shard", "pos")
    files.select("value", "shard").write.partitionBy("shard").text(os.path.join(path, "shards"))
    # the index moves sizes only, no texts
    sizes = lines.select("shard", "pos", (F.octet_length("value") + 1).cast("int").alias("size"))  # with the line's end
    before = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.select("shard", (F.col("pos") % shard_rows).cast("int").alias("line"), F.coalesce(F.sum("size").over(before), F.lit(0)).cast("bigint").alias("begin"), "size", "pos")
    index.write.parquet(os.path.join(path, "index"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(os.path.join(path, "index"))


def read_shards(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """``(pos, value's columns)`` of all shards, each line cut out of its file at the index's bytes.

    A shard meets its part of the index as one row, so its bytes are held once, not once a line; the task that cuts it holds the whole shard.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(os.path.join(path, "shards"))
    files = files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint").alias("shard"), "content")
    lines = read_index(spark, path).groupBy("shard").agg(F.collect_list(F.struct("begin", "size", "pos")).alias("lines"))
    # the small side is hashed, the files are not sorted
    whole = files.join(lines.hint("shuffle_hash"), "shard")
    cut = lambda c, x: F.struct(x["pos"].alias("pos"), F.substring(c, (x["begin"] + 1).cast("int"), x["size"] - 1).cast("string").alias("value"))
    # the file as a variable of a lambda: as a column it would be copied out of the row for each line
    cuts = F.flatten(F.transform(F.array("content"), lambda c: F.transform("lines", lambda x: cut(c, x))))
    rows = whole.select(F.explode(cuts).alias("_l")).select("_l.pos", F.from_json("_l.value", schema).alias("_v"))
    return rows.select("pos", "_v.*")
