import numpy as np
from pyspark.sql import functions as F

from pricelab.functions import constants as K
from pricelab.operators import corpus as CO

from .conftest import bars_df


def test_moments_match_numpy(spark):
    vals = [50000.0 + (k * 7919 % 1000) / 7.0 for k in range(400)]
    m, s = CO.array_moments(F.array(*[F.lit(v) for v in vals]))
    r = spark.range(1).select(m.alias("m"), s.alias("s")).first()
    assert abs(r.m - np.mean(vals)) < 1e-9 and abs(r.s - np.std(vals, ddof=1)) < 1e-9
    m1, s1 = CO.array_moments(F.array(F.lit(3.0)))
    r1 = spark.range(1).select(m1.alias("m"), s1.alias("s")).first()
    assert r1.m == 3.0 and r1.s is None


def test_corpus_frames_have_requested_sizes(spark):
    closes = [100.0 + (k % 17) for k in range(500)]
    df = bars_df(spark, {"A": closes, "B": closes[:250]})
    rows = CO.corpus_positions(df)
    ctx = F.slice("closes", F.col("i") - F.col("context_days") + 1, F.col("context_days"))
    tgt = F.slice("closes", F.col("i") + 1, F.col("pred_days"))
    bad = rows.where((F.size(ctx) != F.col("context_days")) | (F.size(tgt) != F.col("pred_days"))).count()
    assert bad == 0
    c = CO.ts_corpus(df).collect()
    assert c and all(("STOCK: " + r.ticker + "\n") in r.text for r in c)
    assert all(f"CONTEXT_DAYS: {r.context_days}\n" in r.text for r in c)
    # fit rule: i >= c and i + p <= n
    assert all(r.i >= r.context_days for r in c)


def test_corpus_matches_python_render(spark):
    closes = [10.0 + 0.125 * k for k in range(40)]
    df = bars_df(spark, {"T": closes})
    r = CO.ts_corpus(df, fixed=(30, 1)).orderBy("i").first()
    ctx, tgt = closes[0:30], closes[30:31]
    mean, std = np.mean(ctx), np.std(ctx, ddof=1)
    expected = K.TRAINING_PROMPT.format(
        ticker="T", mean=f"{mean:.2f}", std_dev=f"{std:.2f}",
        trend="upward" if ctx[-1] > ctx[0] else "downward", context_days="30",
        context=", ".join(f"{p:.2f}" for p in ctx), pred_days="1", target=", ".join(f"{p:.2f}" for p in tgt))
    assert r.i == 30 and r.text == expected


def test_filter_keeps_untagged(spark):
    df = spark.createDataFrame([("CONTEXT_DAYS: 1825 x",), ("CONTEXT_DAYS: 60 x",), ("no tag",)], "text string")
    assert sorted(r.text for r in CO.filter_context(df).collect()) == ["CONTEXT_DAYS: 60 x", "no tag"]


def test_split_partition_and_cap(spark):
    df = spark.range(0, 3000).select(F.lit("T").alias("ticker"), F.col("id").cast("int").alias("i"))
    s = CO.split_corpus(df, eval_fraction=0.05, eval_cap=50)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == 3000  # whole: every row labelled once
    assert counts["eval"] == 50 and counts.get("eval_overflow", 0) > 0
    s2 = CO.split_corpus(df.repartition(7), eval_fraction=0.05, eval_cap=50)
    a = {(r.i, r.split) for r in s.collect()}
    b = {(r.i, r.split) for r in s2.collect()}
    assert a == b  # stable under re-partitioning


def test_counts_rollup(spark):
    df = spark.createDataFrame([("A", "CONTEXT_DAYS: 30"), ("A", "CONTEXT_DAYS: 1825"), ("B", "none")],
                               "ticker string, text string")
    got = {r.ticker: (r.total, r.kept, r.dropped) for r in CO.corpus_counts(df).collect()}
    assert got == {"A": (2, 1, 1), "B": (1, 1, 0), None: (3, 2, 1)}
