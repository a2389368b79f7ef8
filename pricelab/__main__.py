"""Run a registered query and write its result with Spark.

usage: python -m pricelab <query> <sf_dir> <out_path> [parquet|json|csv] [master]
       python -m pricelab --list

The session comes from ``SparkSession.builder`` (cluster settings from
spark-submit / spark-defaults); ``master`` is only for local runs.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from .plans.catalog import QUERIES

    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0
    if argv[0] == "--list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if len(argv) < 3 or argv[0] not in QUERIES:
        print(__doc__)
        return 2
    name, sf_dir, out = argv[:3]
    fmt = argv[3] if len(argv) > 3 else "parquet"
    from pyspark.sql import SparkSession

    from .session import prepare_session

    existing = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName(f"pricelab-{name}")
    if len(argv) > 4:
        builder = builder.master(argv[4])
    spark = builder.getOrCreate()
    prepare_session(spark)
    df = QUERIES[name](spark, sf_dir)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(out)
    if existing is None:  # stop only a session this run created
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
