"""Queries: sources, features, windows, aggregates and the portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import features as FE
from ..operators import news as NW
from ..operators import portfolio as PF
from . import pipelines as PL
from .catalog import Ctx, r6, register

# ---------------------------------------------------------------------------
# portfolio (the minimum slice)
# ---------------------------------------------------------------------------


@register("pl_portfolio", """
SELECT pos, side, ticker, round(volatility, 6) AS volatility FROM portfolio""", ("portfolio",))
def q_pl_portfolio(spark, sf):
    p = PL.pl_portfolio(Ctx(spark, sf).bars())
    return p.select("pos", "side", "ticker", r6("volatility").alias("volatility"))


@register("ag_annual_volatility", """
SELECT ticker, n, round(volatility, 6) AS volatility FROM volatility""", ("volatility",))
def q_ag_annual_volatility(spark, sf):
    v = PF.annual_volatility(FE.ingest(Ctx(spark, sf).bars(), "2y"))
    return v.select("ticker", "n", r6("volatility").alias("volatility"))


@register("tk_portfolio", """
SELECT side, ticker, round(volatility, 6) AS volatility FROM portfolio""", ("portfolio",))
def q_tk_portfolio(spark, sf):
    v = PF.annual_volatility(FE.ingest(Ctx(spark, sf).bars(), "2y"))
    return PF.select_portfolio(v).select("side", "ticker", r6("volatility").alias("volatility"))


@register("st_concat_portfolio", """
SELECT side, ticker FROM portfolio""", ("portfolio",))
def q_st_concat_portfolio(spark, sf):
    return PL.pl_portfolio(Ctx(spark, sf).bars()).select("side", "ticker")


@register("tk_interleave", """
SELECT CAST(idx * 2 + CASE WHEN side = 'volatile' THEN 0 ELSE 1 END AS BIGINT) AS order_no,
       ticker, side, round(volatility, 6) AS volatility
FROM (SELECT *,
             CASE WHEN side = 'volatile' THEN row_number() OVER (PARTITION BY side ORDER BY pos)
                  ELSE row_number() OVER (PARTITION BY side ORDER BY pos DESC) END - 1 AS idx,
             count(*) FILTER (WHERE side = 'volatile') OVER () AS nv
      FROM portfolio)
WHERE side = 'volatile' OR idx < nv""", ("portfolio",))
def q_tk_interleave(spark, sf):
    i = PF.interleave(PL.pl_portfolio(Ctx(spark, sf).bars()))
    return i.select("order_no", "ticker", "side", r6("volatility").alias("volatility"))


# ---------------------------------------------------------------------------
# ingestion features
# ---------------------------------------------------------------------------


@register("pl_ingest", """
SELECT ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
       round(close, 6) AS close, round(volume, 6) AS volume, round(ma_20, 6) AS ma_20
FROM prices5y""", ("prices5y",))
def q_pl_ingest(spark, sf):
    p = PL.pl_ingest(Ctx(spark, sf).bars())
    return p.select("ticker", "date", *[r6(c).alias(c) for c in ["open", "high", "low", "close", "volume", "ma_20"]])


@register("wn_ma20", """
SELECT ticker, date, round(close, 6) AS close,
       round(CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END, 6) AS ma_20
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", ("bars",))
def q_wn_ma20(spark, sf):
    m = FE.moving_average(Ctx(spark, sf).bars())
    return m.select("ticker", "date", r6("close").alias("close"), r6("ma_20").alias("ma_20"))


@register("prj_drop_incomplete", """
SELECT ticker, CAST(count(*) AS BIGINT) AS n_rows, min(date) AS first_date
FROM (SELECT ticker, date,
             CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS ma_20
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
WHERE ma_20 IS NOT NULL GROUP BY ticker""", ("bars",))
def q_prj_drop_incomplete(spark, sf):
    d = FE.drop_incomplete(FE.moving_average(Ctx(spark, sf).bars()))
    return d.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"))


@register("src_price_history", """
SELECT ticker, date, round(close, 6) AS close FROM bars
WHERE date > (SELECT max(date) FROM bars) - INTERVAL 6 MONTH""", ("bars",))
def q_src_price_history(spark, sf):
    return FE.price_history(Ctx(spark, sf).bars(), "6mo").select("ticker", "date", r6("close").alias("close"))


@register("wn_pct_change", """
SELECT ticker, date,
       round(CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END, 6) AS returns
FROM prices5y WINDOW w AS (PARTITION BY ticker ORDER BY date)""", ("prices5y",))
def q_wn_pct_change(spark, sf):
    p = FE.daily_return(FE.ingest(Ctx(spark, sf).bars()))
    return p.select("ticker", "date", r6("returns").alias("returns"))


@register("wn_abs_change_pct", """
SELECT ticker, date,
       round(abs(CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END) * 100, 6) AS price_change_pct
FROM prices5y WINDOW w AS (PARTITION BY ticker ORDER BY date)""", ("prices5y",))
def q_wn_abs_change_pct(spark, sf):
    p = FE.abs_change_pct(FE.ingest(Ctx(spark, sf).bars()))
    return p.select("ticker", "date", r6("price_change_pct").alias("price_change_pct"))


_CHANGES3MO = """
SELECT ticker, date, close,
       abs(CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END) * 100 AS price_change_pct
FROM prices3mo WINDOW w AS (PARTITION BY ticker ORDER BY date)"""

_LEVELS3MO = f"""
WITH ch AS ({_CHANGES3MO}),
q AS (SELECT ticker, quantile_cont(price_change_pct, [0.25, 0.75]) AS qs FROM ch GROUP BY ticker)
SELECT ch.ticker, ch.date, ch.close, ch.price_change_pct, q.qs[1] AS q25, q.qs[2] AS q75,
       CASE WHEN ch.price_change_pct >= q.qs[2] THEN 'high'
            WHEN ch.price_change_pct >= q.qs[1] THEN 'medium' ELSE 'low' END AS volatility,
       coalesce(ch.price_change_pct >= q.qs[2], false) AS is_volatile
FROM ch JOIN q ON ch.ticker = q.ticker"""

from .oracle import cte  # noqa: E402

cte("levels3mo", ("prices3mo",), _LEVELS3MO)


@register("ag_quantile_thresholds", """
SELECT DISTINCT ticker, round(q25, 6) AS q25, round(q75, 6) AS q75 FROM levels3mo""", ("levels3mo",))
def q_ag_quantile_thresholds(spark, sf):
    p = FE.abs_change_pct(FE.ingest(Ctx(spark, sf).bars(), "3mo"))
    q = FE.change_quantiles(p)
    return q.select("ticker", r6("q25").alias("q25"), r6("q75").alias("q75"))


@register("sc_volatility_level", """
SELECT ticker, date, round(price_change_pct, 6) AS price_change_pct, volatility FROM levels3mo""",
          ("levels3mo",))
def q_sc_volatility_level(spark, sf):
    lv = NW.volatility_levels(FE.ingest(Ctx(spark, sf).bars(), "3mo"))
    return lv.select("ticker", "date", r6("price_change_pct").alias("price_change_pct"), "volatility")


@register("sc_volatile_flag", """
SELECT ticker, date, is_volatile FROM levels3mo""", ("levels3mo",))
def q_sc_volatile_flag(spark, sf):
    lv = NW.volatility_levels(FE.ingest(Ctx(spark, sf).bars(), "3mo"))
    return lv.select("ticker", "date", "is_volatile")


@register("ag_last_actual", """
SELECT ticker, max(date) AS last_date, round(arg_max(close, date), 6) AS last_close
FROM prices5y GROUP BY ticker""", ("prices5y",))
def q_ag_last_actual(spark, sf):
    la = FE.last_actual(FE.ingest(Ctx(spark, sf).bars()))
    return la.select("ticker", "last_date", r6("last_close").alias("last_close"))


@register("ag_distinct_tickers", """
SELECT DISTINCT ticker FROM bars""", ("bars",))
def q_ag_distinct_tickers(spark, sf):
    return FE.distinct_tickers(Ctx(spark, sf).bars())


@register("flt_min_history", f"""
SELECT ticker, date, round(close, 6) AS close FROM (
  SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM prices2y)
WHERE n >= {K.MIN_ROWS_FOR_VOLATILITY}""", ("prices2y",))
def q_flt_min_history(spark, sf):
    p = FE.require_history(FE.ingest(Ctx(spark, sf).bars(), "2y"), K.MIN_ROWS_FOR_VOLATILITY)
    return p.select("ticker", "date", r6("close").alias("close"))
