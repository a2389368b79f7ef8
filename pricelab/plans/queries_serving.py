"""Queries: requests, horizons, forecast parsing, metrics, analyse and backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import (forecast_dates, period_bucket, ticker_from_url, ticker_from_url_split,
                                trend2, trend3, unreliable_jump)
from ..functions.text import (after_marker, fmt2, parse_prices, parse_prices_loose, price_list_text,
                              py_list_text, render)
from ..operators import backtest as BT
from ..operators import features as FE
from ..operators import models as M
from ..operators.corpus import array_moments
from ..operators.horizons import horizon_table, resolve_horizon, validate_requests
from ..sources import tables as T
from . import standins as SI
from .catalog import Ctx, r6, register
from .oracle import (cte, drift_list_sql, fmt2_sql, list_text_sql, mean_sql, render_sql, std_sql)

_HZ_VALUES = ", ".join(f"({p}, {c})" for p, c in K.SERVING_HORIZONS)

cte("rqh", ("rq",), f"""
SELECT r.*, CAST(coalesce(h.p, r.prediction_days) AS INTEGER) AS model_days,
       CAST(coalesce(h.c, {K.FALLBACK_CONTEXT_DAYS}) AS INTEGER) AS context_days
FROM rq r LEFT JOIN (
  SELECT request_id, min(p) AS p, arg_min(c, p) AS c
  FROM rq JOIN (VALUES {_HZ_VALUES}) hz(p, c) ON hz.p >= rq.prediction_days GROUP BY request_id) h
  ON r.request_id = h.request_id""")


def _series(c: Ctx, with_dates=False):
    return FE.series_arrays(FE.ingest(c.bars()), with_dates=with_dates)


def _responses(c: Ctx):
    return T.responses(c.spark, c.sf, c.requests(), _series(c))


def _req(c: Ctx):
    return c.requests().withColumn("ticker", ticker_from_url("url"))


@register("prj_ticker_from_url", f"""
SELECT request_id, ticker,
       CASE WHEN trim(string_split(url, '/')[-1]) <> '' THEN trim(string_split(url, '/')[-1])
            ELSE trim(string_split(url, '/')[-2]) END AS ticker_split
FROM rq""", ("rq",))
def q_prj_ticker_from_url(spark, sf):
    r = Ctx(spark, sf).requests()
    return r.select("request_id", ticker_from_url("url").alias("ticker"),
                    ticker_from_url_split("url").alias("ticker_split"))


@register("flt_request_valid", f"""
SELECT request_id, prediction_days,
       CASE WHEN prediction_days BETWEEN 1 AND 90 THEN NULL ELSE '{K.MSG_BAD_DAYS}' END AS error_message
FROM requests""", ("requests",))
def q_flt_request_valid(spark, sf):
    return validate_requests(Ctx(spark, sf).requests()).select("request_id", "prediction_days", "error_message")


@register("jn_horizon_lookup", """
SELECT request_id, CAST(model_days AS BIGINT) AS model_days, CAST(context_days AS BIGINT) AS context_days
FROM rqh""", ("rqh",))
def q_jn_horizon_lookup(spark, sf):
    r = Ctx(spark, sf).requests()
    h = resolve_horizon(r, horizon_table(spark))
    return h.select("request_id", F.col("model_days").cast("bigint").alias("model_days"),
                    F.col("context_days").cast("bigint").alias("context_days"))


@register("sc_period_bucket", """
SELECT request_id, CAST(context_days AS BIGINT) AS context_days,
       CASE WHEN context_days <= 30 THEN '1mo' WHEN context_days <= 60 THEN '2mo' WHEN context_days <= 90 THEN '3mo'
            WHEN context_days <= 180 THEN '6mo' WHEN context_days <= 365 THEN '1y' WHEN context_days <= 1000 THEN '3y'
            ELSE '5y' END AS period
FROM rqh""", ("rqh",))
def q_sc_period_bucket(spark, sf):
    h = resolve_horizon(Ctx(spark, sf).requests())
    return h.select("request_id", F.col("context_days").cast("bigint").alias("context_days"),
                    period_bucket("context_days").alias("period"))


@register("jn_request_prices", """
SELECT r.request_id, r.ticker, CAST(coalesce(len(s.closes), 0) AS BIGINT) AS n_bars, s.last_date
FROM rq r LEFT JOIN series5y s ON r.ticker = s.ticker""", ("rq", "series5y"))
def q_jn_request_prices(spark, sf):
    c = Ctx(spark, sf)
    j = FE.prices_for(_req(c), _series(c))
    return j.select("request_id", "ticker", F.coalesce(F.size("closes"), F.lit(0)).cast("bigint").alias("n_bars"),
                    "last_date")


_TOKEN_LIST = "[" + ", ".join(f"'{t}'" for t, _ in K.PERIOD_MONTHS) + ", 'never']"
_MONTH_LIST = "[" + ", ".join(str(m) for _, m in K.PERIOD_MONTHS) + ", NULL]"


@register("src_price_history_by_request", f"""
SELECT r.request_id, {_TOKEN_LIST}[r.request_id % 9 + 1] AS period, CAST(count(*) AS BIGINT) AS n_bars, min(b.date) AS first_date, max(b.date) AS last_date,
       round(sum(b.close), 2) AS sum_close
FROM rq r JOIN bars b ON r.ticker = b.ticker AND b.date > (SELECT max(date) FROM bars) - to_months(CAST({_MONTH_LIST}[r.request_id % 9 + 1] AS INTEGER))
GROUP BY r.request_id""", ("rq", "bars"))
def q_src_price_history_by_request(spark, sf):
    """Each request's bars by its own period token: all eight tokens and an unknown one."""
    c = Ctx(spark, sf)
    tokens = F.array(*[F.lit(t) for t, _ in K.PERIOD_MONTHS], F.lit("never"))
    r = _req(c).withColumn("period", F.element_at(tokens, (F.col("request_id") % 9 + 1).cast("int")))
    got = FE.price_history_by_request(c.bars(), r).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.sum("close"), 2).alias("sum_close"))
    return r.select("request_id", "period").join(got, "request_id")


@register("sc_forecast_dates", """
SELECT request_id, CAST(step AS BIGINT) AS step, last_date + CAST(step AS INTEGER) AS date
FROM (SELECT r.request_id, s.last_date, unnest(range(1, r.prediction_days + 1)) AS step
      FROM rq r JOIN series5y s ON r.ticker = s.ticker WHERE r.prediction_days BETWEEN 1 AND 90)""",
          ("rq", "series5y"))
def q_sc_forecast_dates(spark, sf):
    c = Ctx(spark, sf)
    j = _req(c).join(_series(c), "ticker").where(F.col("prediction_days").between(1, 90))
    d = j.select("request_id", F.posexplode(forecast_dates("last_date", F.col("prediction_days"))).alias("k", "date"))
    return d.select("request_id", (F.col("k") + 1).cast("bigint").alias("step"), "date")


cte("parsed", ("responses", "rq"), r"""
SELECT p.request_id, r.prediction_days,
       list_transform(regexp_extract_all(p.text, '(\d+\.?\d*)', 1), lambda s: TRY_CAST(s AS DOUBLE))[1 : r.prediction_days]
         AS forecast
FROM responses p JOIN rq r ON p.request_id = r.request_id""")


def _parsed(c: Ctx):
    resp = _responses(c)
    r = c.requests().select("request_id", "prediction_days")
    j = resp.join(r, "request_id")
    return j.select("request_id", "prediction_days", "text",
                    parse_prices("text", F.col("prediction_days")).alias("forecast"))


@register("sc_parse_prices", f"""
SELECT request_id, CAST(len(forecast) AS BIGINT) AS n_prices, {list_text_sql('forecast')} AS prices_text
FROM parsed""", ("parsed",))
def q_sc_parse_prices(spark, sf):
    p = _parsed(Ctx(spark, sf))
    return p.select("request_id", F.size("forecast").cast("bigint").alias("n_prices"),
                    price_list_text("forecast").alias("prices_text"))


@register("sc_after_marker", """
SELECT request_id, string_split(text, 'PREDICTION:')[2] AS after FROM responses""", ("responses",))
def q_sc_after_marker(spark, sf):
    resp = _responses(Ctx(spark, sf))
    return resp.select("request_id", after_marker("text").alias("after"))


@register("sc_parse_prices_loose", r"""
SELECT request_id,
       NOT list_bool_or(list_transform(toks, lambda t: TRY_CAST(t AS DOUBLE) IS NULL)) AS parsed_ok,
       CAST(len(toks) AS BIGINT) AS n_tokens
FROM (SELECT request_id, regexp_extract_all(string_split(text, 'PREDICTION:')[2], '[\d\.]+') AS toks FROM responses)""",
          ("responses",))
def q_sc_parse_prices_loose(spark, sf):
    resp = _responses(Ctx(spark, sf))
    after = after_marker("text")
    toks = F.regexp_extract_all(after, F.lit(K.RE_PRICE_LOOSE), 0)
    return resp.select("request_id", parse_prices_loose(after).isNotNull().alias("parsed_ok"),
                       F.size(toks).cast("bigint").alias("n_tokens"))


@register("sc_unreliable_jump", """
SELECT r.request_id, coalesce(list_bool_or(list_transform(range(2, len(t) + 1),
         lambda k: t[k] < t[k - 1] * 0.5 OR t[k] > t[k - 1] * 2.0)), false) AS is_unreliable
FROM rq r JOIN (SELECT ticker, closes FROM series5y) s ON r.ticker = s.ticker,
     LATERAL (SELECT s.closes[greatest(len(s.closes) - r.prediction_days + 1, 1) :] AS t)
WHERE r.prediction_days BETWEEN 1 AND 90""", ("rq", "series5y"))
def q_sc_unreliable_jump(spark, sf):
    c = Ctx(spark, sf)
    j = _req(c).join(_series(c), "ticker").where(F.col("prediction_days").between(1, 90))
    t = F.slice("closes", F.greatest(F.size("closes") - F.col("prediction_days") + 1, F.lit(1)), F.col("prediction_days"))
    return j.select("request_id", unreliable_jump(t).alias("is_unreliable"))


@register("sc_trend3", """
SELECT ticker,
       CASE WHEN abs(CASE WHEN t[1] > 0 THEN (t[-1] - t[1]) / t[1] * 100 ELSE 0.0 END) < 5.0 THEN 'stable'
            WHEN t[-1] > t[1] THEN 'upward' ELSE 'downward' END AS trend
FROM (SELECT ticker, closes[greatest(len(closes) - 179, 1) :] AS t FROM series5y)""", ("series5y",))
def q_sc_trend3(spark, sf):
    s = _series(Ctx(spark, sf)).select("ticker", FE.last_n("closes", 180).alias("t"))
    return s.select("ticker", trend3(F.try_element_at("t", F.lit(1)), F.try_element_at("t", F.lit(-1))).alias("trend"))


cte("pairs", ("parsed", "series5y", "rq"), """
SELECT request_id, list_transform(range(1, n + 1), lambda k: {'step': k, 'f': forecast[k], 'a': actual[k]}) AS pairs,
       last_close
FROM (SELECT p.request_id, p.forecast, s.closes[len(s.closes) - p.prediction_days + 1 :] AS actual,
             least(len(p.forecast), p.prediction_days) AS n, s.closes[len(s.closes) - p.prediction_days] AS last_close
      FROM parsed p JOIN rq r ON p.request_id = r.request_id JOIN series5y s ON r.ticker = s.ticker
      WHERE p.prediction_days BETWEEN 1 AND 90 AND len(s.closes) > p.prediction_days)""")


def _pairs(c: Ctx):
    p = _parsed(c).where(F.col("prediction_days").between(1, 90))
    s = _series(c)
    j = p.join(_req(c).select("request_id", "ticker"), "request_id").join(s, "ticker")
    j = j.where(F.size("closes") > F.col("prediction_days"))  # a holdout needs history before it
    n = F.size("closes")
    j = j.withColumn("actual", F.slice("closes", n - F.col("prediction_days") + 1, F.col("prediction_days"))) \
        .withColumn("last_close", F.try_element_at("closes", n - F.col("prediction_days")))
    return j.withColumn("pairs", BT.pair_arrays("forecast", "actual"))


def _mean_list(expr: str) -> str:
    return f"(list_reduce({expr}, lambda a, y: a + y) / len({expr}))"


_ERR = "list_transform(pairs, lambda s: s.f - s.a)"
_MAE = _mean_list(f"list_transform({_ERR}, lambda e: abs(e))")
_MAPE = (f"CASE WHEN list_bool_or(list_transform(pairs, lambda s: s.a = 0)) THEN NULL ELSE "
         f"{_mean_list('list_transform(pairs, lambda s: abs(s.f - s.a) / s.a)')} * 100 END")
_MSE = _mean_list(f"list_transform({_ERR}, lambda e: e * e)")
_DA = ("CASE WHEN len(pairs) > 1 THEN list_reduce(list_transform(range(2, len(pairs) + 1), lambda k: "
       "CASE WHEN sign(pairs[k].f - pairs[k - 1].f) = sign(pairs[k].a - pairs[k - 1].a) THEN 1.0 ELSE 0.0 END), "
       "lambda a, y: a + y) / (len(pairs) - 1) * 100 ELSE 0.0 END")


@register("jn_forecast_actual", """
SELECT request_id, CAST(p.step AS BIGINT) AS step, round(p.f, 6) AS forecast, round(p.a, 6) AS actual
FROM (SELECT request_id, unnest(pairs) AS p FROM pairs)""", ("pairs",))
def q_jn_forecast_actual(spark, sf):
    c = Ctx(spark, sf)
    p = _pairs(c)
    rows = p.select("request_id", F.explode("pairs").alias("s"))  # paired in the row: no join
    return rows.select("request_id", F.col("s.step").cast("bigint").alias("step"), r6("s.forecast").alias("forecast"), r6("s.actual").alias("actual"))


@register("ag_forecast_error", f"""
SELECT request_id, CAST(len(pairs) AS BIGINT) AS n_compared, round({_MAE}, 6) AS mae, round({_MAPE}, 6) AS mape,
       round({_MSE}, 3) AS mse, round(sqrt({_MSE}), 6) AS rmse
FROM pairs WHERE len(pairs) > 0""", ("pairs",))
def q_ag_forecast_error(spark, sf):
    p = _pairs(Ctx(spark, sf)).where(F.size("pairs") > 0)
    m = BT.forecast_error("pairs")
    return p.select("request_id", m["n_compared"].cast("bigint").alias("n_compared"), r6(m["mae"]).alias("mae"),
                    r6(m["mape"]).alias("mape"), F.round(m["mse"], 3).alias("mse"), r6(m["rmse"]).alias("rmse"))


@register("ag_directional_accuracy", f"""
SELECT request_id, round({_DA}, 6) AS directional_accuracy FROM pairs WHERE len(pairs) > 0""", ("pairs",))
def q_ag_directional_accuracy(spark, sf):
    p = _pairs(Ctx(spark, sf)).where(F.size("pairs") > 0)
    return p.select("request_id", r6(BT.directional_accuracy("pairs")).alias("directional_accuracy"))


@register("ag_forecast_bias", """
SELECT p.request_id, CASE WHEN list_reduce(p.forecast, lambda a, y: a + y) / len(p.forecast) > x.last_close
                          THEN 'bullish' ELSE 'bearish' END AS outlook
FROM parsed p JOIN (SELECT request_id, last_close FROM pairs) x ON p.request_id = x.request_id
WHERE len(p.forecast) > 0""", ("parsed", "pairs"))
def q_ag_forecast_bias(spark, sf):
    p = _pairs(Ctx(spark, sf)).where(F.size("forecast") > 0)
    return p.select("request_id", BT.outlook("forecast", "last_close").alias("outlook"))


@register("sc_inference_prompt", """
SELECT ticker, md5(""" + render_sql(K.PLAIN_INFERENCE_PROMPT, ticker="ticker", mean=fmt2_sql(mean_sql("t")),
                                   std_dev=fmt2_sql(std_sql("t")),
                                   trend="CASE WHEN t[-1] > t[1] THEN 'upward' ELSE 'downward' END",
                                   context_days="CAST(len(t) AS VARCHAR)", context=list_text_sql("t"),
                                   pred_days="'5'") + """) AS prompt_md5
FROM (SELECT ticker, closes[greatest(len(closes) - 59, 1) :] AS t FROM series5y)""", ("series5y",))
def q_sc_inference_prompt(spark, sf):
    s = _series(Ctx(spark, sf)).select("ticker", FE.last_n("closes", 60).alias("t"))
    mean, std = array_moments(F.col("t"))
    p = render(K.PLAIN_INFERENCE_PROMPT, ticker="ticker", mean=fmt2(mean), std_dev=fmt2(std),
               trend=trend2(F.try_element_at("t", F.lit(1)), F.try_element_at("t", F.lit(-1))),
               context_days=F.size("t").cast("string"), context=price_list_text("t"), pred_days=F.lit("5"))
    return s.select("ticker", F.md5(p).alias("prompt_md5"))


@register("sc_one_shot_prompt", """
SELECT request_id, md5(""" + render_sql(
    K.ONE_SHOT_PROMPT, ticker="ticker", example_context=list_text_sql("ctx[len(ctx) - h - 59 : len(ctx) - h]"),
    pred_days="CAST(h AS VARCHAR)", example_target=list_text_sql("ctx[len(ctx) - h + 1 : len(ctx)]"),
    mean=fmt2_sql(mean_sql("ctx")), std_dev=fmt2_sql(std_sql("ctx")),
    trend="CASE WHEN ctx[-1] > ctx[1] THEN 'upward' ELSE 'downward' END",
    context_days="CAST(len(ctx) AS VARCHAR)", context=list_text_sql("ctx")) + """) AS prompt_md5
FROM (SELECT r.request_id, r.ticker, r.prediction_days AS h, s.closes[1 : len(s.closes) - r.prediction_days] AS ctx
      FROM rq r JOIN series5y s ON r.ticker = s.ticker
      WHERE r.prediction_days BETWEEN 1 AND 90 AND len(s.closes) - r.prediction_days - r.prediction_days >= 60)""",
          ("rq", "series5y"))
def q_sc_one_shot_prompt(spark, sf):
    c = Ctx(spark, sf)
    j = _req(c).join(_series(c), "ticker").where(F.col("prediction_days").between(1, 90))
    j = j.withColumn("ctx", F.slice("closes", F.lit(1), F.greatest(F.size("closes") - F.col("prediction_days"), F.lit(0))))
    j = j.where(F.size("ctx") - F.col("prediction_days") >= K.ONE_SHOT_CONTEXT)
    ex_c, ex_t = BT.one_shot_example(F.col("ctx"), F.col("prediction_days"))
    mean, std = array_moments(F.col("ctx"))
    p = render(K.ONE_SHOT_PROMPT, ticker="ticker", example_context=price_list_text(ex_c),
               pred_days=F.col("prediction_days").cast("string"), example_target=price_list_text(ex_t),
               mean=fmt2(mean), std_dev=fmt2(std),
               trend=trend2(F.try_element_at("ctx", F.lit(1)), F.try_element_at("ctx", F.lit(-1))),
               context_days=F.size("ctx").cast("string"), context=price_list_text("ctx"))
    return j.select("request_id", F.md5(p).alias("prompt_md5"))


def _py_list_sql(arr: str) -> str:
    return f"'[' || array_to_string(list_transform({arr}, lambda x: CAST(x AS VARCHAR)), ', ') || ']'"


_WARN_SQL = render_sql("{w}", w="'" + K.UNRELIABLE_WARNING.replace("'", "''") + "'")
_REPORT_SQL = render_sql(
    K.ANALYST_REPORT_PROMPT, ticker="ticker",
    warning=f"CASE WHEN coalesce(list_bool_or(list_transform(range(2, len(t) + 1), lambda k: t[k] < t[k - 1] * 0.5 "
            f"OR t[k] > t[k - 1] * 2.0)), false) THEN {_WARN_SQL} ELSE '' END",
    last_price=fmt2_sql("closes[-1]"), pred_days="'5'", forecast=_py_list_sql("t"),
    sentiment=f"'{K.NO_NEWS_SUMMARY}'")


@register("sc_report_prompts", f"""
SELECT ticker, md5({_REPORT_SQL}) AS prompt_md5 FROM (SELECT ticker, closes, closes[greatest(len(closes) - 4, 1) :] AS t FROM series5y)""",
          ("series5y",))
def q_sc_report_prompts(spark, sf):
    s = _series(Ctx(spark, sf)).withColumn("t", FE.last_n("closes", 5))
    warning = F.when(unreliable_jump("t"), F.lit(K.UNRELIABLE_WARNING)).otherwise(F.lit(""))
    p = render(K.ANALYST_REPORT_PROMPT, ticker="ticker", warning=warning,
               last_price=fmt2(F.try_element_at("closes", F.lit(-1))), pred_days=F.lit("5"),
               forecast=py_list_text("t"), sentiment=F.lit(K.NO_NEWS_SUMMARY))
    return s.select("ticker", F.md5(p).alias("prompt_md5"))


@register("ud_write_text", f"""
SELECT ticker, 'REPORT ' || substr(md5({_REPORT_SQL}), 1, 12) AS report
FROM (SELECT ticker, closes, closes[greatest(len(closes) - 4, 1) :] AS t FROM series5y)""", ("series5y",))
def q_ud_write_text(spark, sf):
    s = _series(Ctx(spark, sf)).withColumn("t", FE.last_n("closes", 5))
    warning = F.when(unreliable_jump("t"), F.lit(K.UNRELIABLE_WARNING)).otherwise(F.lit(""))
    p = render(K.ANALYST_REPORT_PROMPT, ticker="ticker", warning=warning,
               last_price=fmt2(F.try_element_at("closes", F.lit(-1))), pred_days=F.lit("5"),
               forecast=py_list_text("t"), sentiment=F.lit(K.NO_NEWS_SUMMARY))
    out = M.generate(s.withColumn("_p", p), "_p", "report", SI.md5_writer)
    return out.select("ticker", "report")


# ---------------------------------------------------------------------------
# ud_forecast: serving prompt (initial summary) -> drift stand-in -> parse
# ---------------------------------------------------------------------------

def _serving_prompt_sql(summary: str, ctx: str, last: str) -> str:
    fin = f"{ctx}[greatest(len({ctx}) - 179, 1) :]"
    trend = (f"CASE WHEN abs(CASE WHEN {fin}[1] > 0 THEN ({fin}[-1] - {fin}[1]) / {fin}[1] * 100 ELSE 0.0 END) < 5.0 "
             f"THEN 'stable' WHEN {fin}[-1] > {fin}[1] THEN 'upward' ELSE 'downward' END")
    return render_sql(K.SERVING_PROMPT, summary=summary, ticker="ticker", last_price=fmt2_sql(last),
                      mean=fmt2_sql(mean_sql(fin)), std_dev=fmt2_sql(std_sql(fin)), trend=trend,
                      context_days=f"CAST(len({fin}) AS VARCHAR)", context=list_text_sql(fin),
                      pred_days="CAST(model_days AS VARCHAR)")


def _drift_forecast_sql(prompt: str, last: str) -> str:
    """Parsed forecast of the drift stand-in for ``prompt`` (truncated to prediction_days)."""
    mode = f"(('0x' || substr(md5({prompt}), 1, 1))::INT % 5)"
    k = f"CASE {mode} WHEN 1 THEN model_days + 3 WHEN 2 THEN greatest(model_days // 2, 1) ELSE model_days END"
    lst = drift_list_sql(f"CAST(printf('%.2f', {last}) AS DOUBLE)", k)
    return (f"CASE WHEN {mode} = 4 THEN []::DOUBLE[] ELSE "
            f"list_transform({lst}, lambda s: CAST(s AS DOUBLE))[1 : prediction_days] END")


cte("rq_ok", ("rqh", "series5y"), """
SELECT r.*, s.closes, s.dates, s.last_date FROM rqh r JOIN series5y s ON r.ticker = s.ticker
WHERE r.prediction_days BETWEEN 1 AND 90 AND len(s.closes) >= r.context_days""")


@register("ud_forecast", f"""
SELECT request_id, CAST(len(fc) AS BIGINT) AS n_prices, {list_text_sql('fc')} AS prices_text
FROM (SELECT request_id, {_drift_forecast_sql('prompt', 'closes[-1]')} AS fc
      FROM (SELECT *, {_serving_prompt_sql("'" + K.INITIAL_SUMMARY + "'", 'ctx', 'closes[-1]')} AS prompt
            FROM (SELECT *, closes[len(closes) - context_days + 1 :] AS ctx FROM rq_ok)))""", ("rq_ok",))
def q_ud_forecast(spark, sf):
    c = Ctx(spark, sf)
    j = resolve_horizon(validate_requests(_req(c)))
    j = j.where(F.col("error_message").isNull()).join(_series(c), "ticker")
    j = j.where(F.size("closes") >= F.col("context_days"))
    j = j.withColumn("ctx", F.slice("closes", F.size("closes") - F.col("context_days") + 1, F.col("context_days")))
    fin = F.slice("ctx", F.greatest(F.size("ctx") - 179, F.lit(1)), F.lit(180))
    j = j.withColumn("_f", fin)
    mean, std = array_moments(F.col("_f"))
    p = render(K.SERVING_PROMPT, summary=F.lit(K.INITIAL_SUMMARY), ticker="ticker",
               last_price=fmt2(F.try_element_at("closes", F.lit(-1))), mean=fmt2(mean), std_dev=fmt2(std),
               trend=trend3(F.try_element_at("_f", F.lit(1)), F.try_element_at("_f", F.lit(-1))),
               context_days=F.size("_f").cast("string"), context=price_list_text("_f"),
               pred_days=F.col("model_days").cast("string"))
    out = M.generate(j.withColumn("_p", p), "_p", "_t", SI.drift_forecaster)
    out = out.withColumn("fc", parse_prices("_t", F.col("prediction_days")))
    return out.select("request_id", F.size("fc").cast("bigint").alias("n_prices"),
                      price_list_text("fc").alias("prices_text"))

