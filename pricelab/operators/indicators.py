"""Statistical indicators announced in the application's road map (not implemented there).

The road map names the indicators but not their formulas, so the standard
definitions are used and written down here:

* rolling volatility: sample std of the last ``k`` daily returns (``k`` = 20),
  defined only once ``k`` returns exist; ``HIGH`` when it is at or above the
  ticker's median rolling volatility, else ``LOW`` (compared at 9 decimals).
* moving-average cross: 50- and 200-row simple averages (each defined only on
  a full window); ``above`` = MA50 > MA200, ``cross_up`` = above now and not on
  the previous row.
* RSI(14), simple-average form: mean gain / mean loss over the last 14 price
  changes, ``100 - 100 / (1 + gain / loss)``; 100 when there is no loss.
  (Wilder's smoothing is recursive; the simple form is a window aggregate.)
* support / resistance: local minima / maxima (close below / above both
  neighbours), bucketed to ``width`` and counted per level.
* stats string: ``STATS: {VOLATILITY: .., TREND: .., RSI: .., MA50_X_MA200: ..}``
  from the latest row of each ticker.

All are window functions over ``partitionBy('ticker').orderBy('date')``:
one exchange, one sort, shared by every frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import W, W_ALL, W_DESC


def rolling_volatility(prices: DataFrame, k: int = 20) -> DataFrame:
    """Adds ``vol`` and ``vol_level`` (HIGH / LOW against the ticker's median)."""
    ret = F.try_divide(F.col("close"), F.lag("close").over(W())) - 1
    frame = W().rowsBetween(-(k - 1), 0)
    x = prices.withColumn("_r", ret)
    x = x.withColumn("vol", F.when(F.count("_r").over(frame) == k, F.stddev_samp("_r").over(frame)))
    x = x.withColumn("_v9", F.round("vol", 9))
    # median as a whole-partition window aggregate: same exchange and sort, no join back
    x = x.withColumn("_med", F.percentile("_v9", 0.5).over(W_ALL()))
    level = F.when(F.col("_v9").isNull(), F.lit(None)).when(F.col("_v9") >= F.col("_med"), "HIGH").otherwise("LOW")
    return x.withColumn("vol_level", level).drop("_r", "_v9", "_med")


def _ma(n: int):
    frame = W().rowsBetween(-(n - 1), 0)
    return F.when(F.count("close").over(frame) == n, F.avg("close").over(frame))


def ma_cross(prices: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Adds ``ma50``, ``ma200``, ``above`` and ``cross_up``."""
    x = prices.withColumn("ma50", _ma(fast)).withColumn("ma200", _ma(slow))
    x = x.withColumn("above", F.col("ma50") > F.col("ma200"))
    return x.withColumn("cross_up", F.col("above") & ~F.coalesce(F.lag("above").over(W()), F.lit(True)))


def rsi(prices: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``rsi`` (simple-average RSI over ``n`` changes)."""
    d = F.col("close") - F.lag("close").over(W())
    x = prices.withColumn("_d", d)
    frame = W().rowsBetween(-(n - 1), 0)
    gain = F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(frame)
    loss = F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame)
    full = F.count("_d").over(frame) == n
    x = x.withColumn("_g", F.when(full, gain)).withColumn("_l", F.when(full, loss))
    val = F.when(F.col("_l") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    return x.withColumn("rsi", F.when(F.col("_g").isNotNull(), val)).drop("_d", "_g", "_l")


def support_resistance(prices: DataFrame, width: float = 1000.0) -> DataFrame:
    """``(ticker, kind, level, touches)`` from local extrema bucketed to ``width``."""
    prev, nxt = F.lag("close").over(W()), F.lead("close").over(W())
    x = prices.select("ticker", "close", prev.alias("_p"), nxt.alias("_n"))
    kind = (F.when((F.col("close") < F.col("_p")) & (F.col("close") < F.col("_n")), "support")
            .when((F.col("close") > F.col("_p")) & (F.col("close") > F.col("_n")), "resistance"))
    x = x.withColumn("kind", kind).where(F.col("kind").isNotNull())
    x = x.withColumn("level", F.round(F.col("close") / width) * width)
    return x.groupBy("ticker", "kind", "level").agg(F.count(F.lit(1)).alias("touches"))


def stats_string(prices: DataFrame) -> DataFrame:
    """``(ticker, stats)`` for the latest row of each ticker."""
    x = ma_cross(rsi(rolling_volatility(prices)))
    last = x.withColumn("_rn", F.row_number().over(W_DESC())).where(F.col("_rn") == 1)
    na = F.lit("NA")
    vol = F.coalesce(F.col("vol_level"), na)
    trend = F.when(F.col("ma50").isNull(), na).when(F.col("close") > F.col("ma50"), "BULLISH").otherwise("BEARISH")
    r = F.coalesce(F.floor(F.col("rsi") + 0.5).cast("bigint").cast("string"), na)
    cross = F.when(F.col("above").isNull(), na).when(F.col("above"), "TRUE").otherwise("FALSE")
    s = F.concat(F.lit("STATS: {VOLATILITY: "), vol, F.lit(", TREND: "), trend, F.lit(", RSI: "), r,
                 F.lit(", MA50_X_MA200: "), cross, F.lit("}"))
    return last.select("ticker", s.alias("stats"))

