"""Annualised volatility, the 8 + 7 portfolio and its interleaved processing order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .features import W


def annual_volatility(prices: DataFrame, min_rows: int = K.MIN_ROWS_FOR_VOLATILITY,
                      days: int = K.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """``(ticker, n, volatility)``: sample std of daily returns x sqrt(days).

    Tickers with fewer than ``min_rows`` rows are dropped, as are tickers whose
    std is undefined or that have a step from a zero close to a non-zero close
    (an infinite return makes the std undefined in the application).
    One window pass for ``lag`` and one partial+final aggregate per ticker.
    """
    prev = F.lag("close").over(W())
    r = prices.select("ticker", "close", prev.alias("prev"))
    ret = F.try_divide(F.col("close"), F.col("prev")) - 1
    agg = (r.groupBy("ticker")
           .agg(F.count(F.lit(1)).alias("n"),
                (F.stddev_samp(ret) * math.sqrt(days)).alias("volatility"),
                F.count_if((F.col("prev") == 0) & (F.col("close") != 0)).alias("_inf")))
    return (agg.where((F.col("n") >= min_rows) & F.col("volatility").isNotNull() & (F.col("_inf") == 0)
                      & ~F.isnan("volatility"))
            .select("ticker", F.col("n").cast("bigint").alias("n"), "volatility"))


def select_portfolio(vol: DataFrame, n_volatile: int = K.NUM_VOLATILE, n_stable: int = K.NUM_STABLE) -> DataFrame:
    """``(pos, side, ticker, volatility)``: top ``n_volatile`` then the last ``n_stable``
    of the descending ranking, only volatility > 0. Ties break on ticker.

    Both sides are distributed top-k (``TakeOrderedAndProject``); the positions
    are numbered on at most 15 rows.
    """
    pos = vol.where(F.col("volatility") > 0).select("ticker", "volatility")
    top = (pos.orderBy(F.col("volatility").desc(), F.col("ticker").asc()).limit(n_volatile)
           .withColumn("side", F.lit("volatile")))
    bottom = (pos.orderBy(F.col("volatility").asc(), F.col("ticker").desc()).limit(n_stable)
              .withColumn("side", F.lit("stable")))
    both = top.unionByName(bottom)
    # positions inside the (bounded) result: descending order, volatile side first
    w = Window.orderBy(F.col("side").desc(), F.col("volatility").desc(), F.col("ticker").asc())
    return both.select((F.row_number().over(w) - 1).cast("bigint").alias("pos"), "side", "ticker", "volatility")


def interleave(portfolio: DataFrame) -> DataFrame:
    """Processing order: most volatile, most stable, 2nd most volatile, 2nd most stable...

    Stable entries are taken most-stable-first and only while a volatile
    partner exists (the application would index past its list otherwise).
    """
    v = Window.partitionBy("side").orderBy(F.col("pos").asc())
    s = Window.partitionBy("side").orderBy(F.col("pos").desc())
    idx = F.when(F.col("side") == "volatile", F.row_number().over(v)).otherwise(F.row_number().over(s)) - 1
    x = portfolio.withColumn("_idx", idx)
    n_vol = F.count_if(F.col("side") == "volatile").over(Window.partitionBy())
    x = x.withColumn("_nv", n_vol)
    x = x.where((F.col("side") == "volatile") | (F.col("_idx") < F.col("_nv")))
    order = F.col("_idx") * 2 + F.when(F.col("side") == "volatile", 0).otherwise(1)
    return x.select(order.cast("bigint").alias("order_no"), "ticker", "side", "volatility")


def portfolio_json_rows(portfolio: DataFrame) -> DataFrame:
    """Tickers in portfolio order (the order of the JSON array)."""
    return portfolio.orderBy("pos").select("pos", "ticker")
