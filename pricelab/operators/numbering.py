"""Dense positions in a global order, without a single ordered task.

Rows are range-partitioned and sorted, written with their place in the range (so that
the ranges are fixed), and get the number of rows in the ranges before as an offset: an
ordered sum over one row a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def numbered(df: DataFrame, *order: str, pos: str = "pos", ranges: int | None = None) -> DataFrame:
    """``df`` with ``pos`` = 0, 1, 2, ... in the order of the columns ``order`` (NULL first; rows equal in all of them in any order)."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the id's high bits are the range, its low 33 bits the place in it
    path = scratch_path(spark, "ranges")
    rows.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(offsets, F.col("_range") == F.col("_r"))
    return out.withColumn(pos, (F.col("_before") + F.col("_place")).cast("bigint")).select(*df.columns, pos)


def numbered_keys(df: DataFrame, key: str = "ticker", pos: str = "pos") -> DataFrame:
    """``(pos, key)``: the different non-NULL keys by their order."""
    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), key, pos=pos).select(pos, key)
