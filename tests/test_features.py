import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelab.operators import features as FE
from pricelab.operators import portfolio as PF

from .conftest import bars_df


def overlap_loop(n, size, overlap):
    chunks, start = 0, 0
    while start < n:
        end = start + size
        chunks += 1
        start += size - overlap
        if end >= n:
            break
    return chunks


@pytest.mark.parametrize("size,overlap", [(180, 30), (10, 3), (7, 6), (5, 0)])
def test_chunk_count_closed_form(spark, size, overlap):
    df = spark.range(0, 700).select(F.col("id").cast("int").alias("n"))
    got = df.select("n", FE.overlap_chunk_count(F.col("n"), size, overlap).alias("c")).toPandas()
    for n, c in zip(got.n, got.c):
        assert c == overlap_loop(n, size, overlap), (n, size, overlap)


def test_chunk_overlap_rejected():
    with pytest.raises(ValueError):
        FE.overlap_chunk_count(None, 10, 10)


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 50])
def test_ma20_guard_and_pandas_parity(spark, n):
    closes = [100.0 + (k * 37 % 11) for k in range(n)]
    df = bars_df(spark, {"T": closes})
    got = FE.moving_average(df).orderBy("date").select("ma_20").toPandas()["ma_20"].tolist()
    ref = pd.Series(closes, dtype=float).rolling(20).mean().tolist()
    assert len(got) == n
    for g, r in zip(got, ref):
        if math.isnan(r):
            assert g is None or (isinstance(g, float) and math.isnan(g))
        else:
            assert abs(g - r) < 1e-9
    assert FE.drop_incomplete(FE.moving_average(df)).count() == max(0, n - 19)


def test_tail_and_holdout(spark):
    df = bars_df(spark, {"A": [float(x) for x in range(10)], "B": [1.0, 2.0]})
    t = FE.tail_n(df, 3).groupBy("ticker").agg(F.sort_array(F.collect_list("close")).alias("c"))
    got = {r.ticker: r.c for r in t.collect()}
    assert got == {"A": [7.0, 8.0, 9.0], "B": [1.0, 2.0]}
    h = FE.holdout_split(df.where("ticker = 'A'"), 2).where("part = 'truth'").select("close").collect()
    assert sorted(r[0] for r in h) == [8.0, 9.0]


def test_volatility_and_quantiles_match_pandas(spark):
    rng = np.random.default_rng(7)
    closes = [float(x) for x in 100 * np.cumprod(1 + rng.normal(0, 0.02, 120))]
    df = bars_df(spark, {"T": closes})
    v = PF.annual_volatility(df).first()["volatility"]
    s = pd.Series(closes)
    assert abs(v - s.pct_change().std() * np.sqrt(252)) < 1e-12
    ch = FE.abs_change_pct(df)
    q = FE.change_quantiles(ch).first()
    ref = (s.pct_change().abs() * 100).quantile([0.25, 0.75]).tolist()
    assert abs(q.q25 - ref[0]) < 1e-9 and abs(q.q75 - ref[1]) < 1e-9


def test_volatility_drops_short_and_infinite(spark):
    df = bars_df(spark, {"SHORT": [1.0 + k for k in range(49)], "ZERO": [0.0] + [1.0 + k for k in range(60)],
                         "OK": [1.0 + (k % 3) for k in range(60)], "FLAT": [5.0] * 60})
    got = {r.ticker: r.volatility for r in PF.annual_volatility(df).collect()}
    assert "SHORT" not in got and "ZERO" not in got and "OK" in got
    assert got["FLAT"] == 0.0


def test_portfolio_few_tickers_overlap(spark):
    vol = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("C", 0.1), ("Z", 0.0)], "ticker string, volatility double")
    p = PF.select_portfolio(vol).orderBy("pos").collect()
    assert [(r.side, r.ticker) for r in p] == [("volatile", "A"), ("volatile", "B"), ("volatile", "C"),
                                                ("stable", "A"), ("stable", "B"), ("stable", "C")]
    order = PF.interleave(PF.select_portfolio(vol)).orderBy("order_no").collect()
    assert [r.ticker for r in order] == ["A", "C", "B", "B", "C", "A"]


def test_ma20_null_close_matches_pandas(spark):
    closes = [100.0 + k for k in range(45)]
    closes[25] = None
    df = bars_df(spark, {"T": closes})
    got = FE.moving_average(df).orderBy("date").select("ma_20").toPandas()["ma_20"].tolist()
    ref = pd.Series([float("nan") if c is None else c for c in closes]).rolling(20).mean().tolist()
    for g, r in zip(got, ref):
        assert (g is None or g != g) if math.isnan(r) else abs(g - r) < 1e-9
    # ingestion drops every row whose 20-row window touches the gap, like dropna after rolling
    assert FE.drop_incomplete(FE.moving_average(df)).count() == sum(1 for r in ref if not math.isnan(r))
