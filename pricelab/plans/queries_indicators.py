"""Queries: road-map indicators (rolling volatility, MA cross, RSI, levels, stats string)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import indicators as IN
from .catalog import Ctx, r6, register
from .oracle import cte

cte("ind0", ("prices5y",), """
SELECT *, CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END AS r,
       close - lag(close) OVER w AS d
FROM prices5y WINDOW w AS (PARTITION BY ticker ORDER BY date)""")

cte("ind1", ("ind0",), """
SELECT ticker, date, close,
       CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 END AS vol,
       CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS ma50,
       CASE WHEN count(close) OVER w200 = 200 THEN avg(close) OVER w200 END AS ma200,
       CASE WHEN count(d) OVER w14 = 14 THEN avg(greatest(d, 0.0)) OVER w14 END AS g,
       CASE WHEN count(d) OVER w14 = 14 THEN avg(greatest(-d, 0.0)) OVER w14 END AS l
FROM ind0
WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
       w50 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
       w200 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW),
       w14 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")

cte("ind2", ("ind1",), """
SELECT *, round(vol, 9) AS v9, ma50 > ma200 AS above,
       CASE WHEN g IS NULL THEN NULL WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END AS rsi
FROM ind1""")

cte("ind", ("ind2",), """
SELECT *, CASE WHEN v9 IS NULL THEN NULL WHEN v9 >= med THEN 'HIGH' ELSE 'LOW' END AS vol_level
FROM (SELECT *, quantile_cont(v9, 0.5) OVER (PARTITION BY ticker) AS med FROM ind2)""")


@register("pn_rolling_volatility", """
SELECT ticker, date, round(vol, 6) AS vol, vol_level FROM ind WHERE vol IS NOT NULL""", ("ind",))
def q_pn_rolling_volatility(spark, sf):
    x = IN.rolling_volatility(FE.ingest(Ctx(spark, sf).bars())).where(F.col("vol").isNotNull())
    return x.select("ticker", "date", r6("vol").alias("vol"), "vol_level")


@register("pn_ma_cross", """
SELECT ticker, date, round(ma50, 6) AS ma50, round(ma200, 6) AS ma200, above,
       above AND NOT coalesce(lag(above) OVER (PARTITION BY ticker ORDER BY date), true) AS cross_up
FROM ind QUALIFY ma200 IS NOT NULL""", ("ind",))
def q_pn_ma_cross(spark, sf):
    x = IN.ma_cross(FE.ingest(Ctx(spark, sf).bars()))
    return x.where(F.col("ma200").isNotNull()).select("ticker", "date", r6("ma50").alias("ma50"),
                                                      r6("ma200").alias("ma200"), "above", "cross_up")


@register("pn_rsi", """
SELECT ticker, date, round(rsi, 6) AS rsi FROM ind WHERE rsi IS NOT NULL""", ("ind",))
def q_pn_rsi(spark, sf):
    x = IN.rsi(FE.ingest(Ctx(spark, sf).bars())).where(F.col("rsi").isNotNull())
    return x.select("ticker", "date", r6("rsi").alias("rsi"))


@register("pn_support_resistance", """
SELECT ticker, kind, round(close / 1000.0) * 1000.0 AS level, CAST(count(*) AS BIGINT) AS touches
FROM (SELECT ticker, close,
             CASE WHEN close < lag(close) OVER w AND close < lead(close) OVER w THEN 'support'
                  WHEN close > lag(close) OVER w AND close > lead(close) OVER w THEN 'resistance' END AS kind
      FROM prices5y WINDOW w AS (PARTITION BY ticker ORDER BY date))
WHERE kind IS NOT NULL GROUP BY ticker, kind, level""", ("prices5y",))
def q_pn_support_resistance(spark, sf):
    x = IN.support_resistance(FE.ingest(Ctx(spark, sf).bars()))
    return x.select("ticker", "kind", "level", F.col("touches").cast("bigint"))


@register("pn_stats_string", """
SELECT ticker, 'STATS: {VOLATILITY: ' || coalesce(vol_level, 'NA')
       || ', TREND: ' || CASE WHEN ma50 IS NULL THEN 'NA' WHEN close > ma50 THEN 'BULLISH' ELSE 'BEARISH' END
       || ', RSI: ' || coalesce(CAST(CAST(floor(rsi + 0.5) AS BIGINT) AS VARCHAR), 'NA')
       || ', MA50_X_MA200: ' || CASE WHEN above IS NULL THEN 'NA' WHEN above THEN 'TRUE' ELSE 'FALSE' END || '}' AS stats
FROM ind QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""", ("ind",))
def q_pn_stats_string(spark, sf):
    return IN.stats_string(FE.ingest(Ctx(spark, sf).bars()))
