"""Queries: the analyse and backtest pipelines end to end (stand-in models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import price_list_text
from . import pipelines as PL
from . import standins as SI
from .catalog import Ctx, r6, register
from .oracle import cte, fmt2_sql, list_text_sql, render_sql
from .queries_news import _LINE_SQL
from .queries_serving import _DA, _MAE, _MAPE, _MSE, _drift_forecast_sql, _py_list_sql, _serving_prompt_sql


def _chunks_sql(src: str, ctx: str) -> str:
    return f"""
SELECT request_id, chunk_no, {ctx}[chunk_no * 150 + 1 : chunk_no * 150 + 180] AS chunk
FROM (SELECT request_id, {ctx}, unnest(range(CASE WHEN len({ctx}) = 0 THEN 0 WHEN len({ctx}) <= 180 THEN 1
                        ELSE CAST(ceil((len({ctx}) - 180) / 150.0) AS BIGINT) + 1 END)) AS chunk_no FROM {src})"""


def _summary_sql(chunks: str) -> str:
    return f"""
SELECT request_id,
       CASE WHEN m = 0 THEN '{K.INITIAL_SUMMARY}'
            ELSE CAST(last_n AS VARCHAR) || ' closes from ' || printf('%.2f', last_first) || ' to '
                 || printf('%.2f', last_last) || '.' END AS summary
FROM (SELECT request_id, count(*) FILTER (WHERE len(chunk) >= 31) AS m,
             arg_max(len(chunk), chunk_no) FILTER (WHERE len(chunk) >= 31) AS last_n,
             arg_max(chunk[1], chunk_no) FILTER (WHERE len(chunk) >= 31) AS last_first,
             arg_max(chunk[-1], chunk_no) FILTER (WHERE len(chunk) >= 31) AS last_last
      FROM {chunks} GROUP BY request_id)"""


def _blocks_sql(as_of: str, feed_bounded: bool) -> str:
    upper = "AND h.date <= a.as_of" if feed_bounded else ""
    return f"""
SELECT ticker, as_of, CAST(count(*) AS BIGINT) AS n_headlines,
       string_agg(line, chr(10) ORDER BY date, title, line) AS headline_block
FROM (SELECT ticker, as_of, date, title, {_LINE_SQL} AS line FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker, as_of, title ORDER BY published_at, date) AS rn2 FROM (
          SELECT ticker, as_of, title, published_at, date FROM (
            SELECT h.*, a.as_of, row_number() OVER (PARTITION BY h.ticker, a.as_of ORDER BY h.relevancy, h.title) AS rn
            FROM headlines h JOIN {as_of} a ON h.ticker = a.ticker
            WHERE h.source = 'documents' AND h.lang = 'en' AND h.date BETWEEN a.as_of - 5 AND a.as_of)
          WHERE rn <= 20
          UNION ALL
          SELECT h.ticker, a.as_of, h.title, h.published_at, h.date
          FROM headlines h JOIN {as_of} a ON h.ticker = a.ticker WHERE h.source = 'pages' {upper})
        WHERE title IS NOT NULL AND title <> '')
      WHERE rn2 = 1)
GROUP BY ticker, as_of"""


def _writer_sql(prompt: str) -> str:
    return f"'REPORT ' || substr(md5({prompt}), 1, 12)"


_SYNTH = render_sql(K.SENTIMENT_SYNTHESIS_PROMPT, ticker="g.ticker", headlines="b.headline_block")

# ---------------------------------------------------------------------------
# analyse
# ---------------------------------------------------------------------------

cte("an_ok", ("rqh", "series5y"), """
SELECT r.request_id, r.ticker, r.prediction_days, r.model_days, r.context_days, s.last_date,
       s.closes[-1] AS last_actual, s.closes[len(s.closes) - r.context_days + 1 :] AS ctx
FROM rqh r JOIN series5y s ON r.ticker = s.ticker
WHERE r.prediction_days BETWEEN 1 AND 90 AND len(s.closes) >= r.context_days""")
cte("an_chunks", ("an_ok",), _chunks_sql("an_ok", "ctx"))
cte("an_summary", ("an_chunks",), _summary_sql("an_chunks"))
cte("an_fc", ("an_ok", "an_summary"), f"""
SELECT *, {_drift_forecast_sql('prompt', 'last_actual')} AS fc FROM (
  SELECT o.*, sm.summary, {_serving_prompt_sql('sm.summary', 'o.ctx', 'o.last_actual')} AS prompt
  FROM an_ok o JOIN an_summary sm ON o.request_id = sm.request_id)""")
cte("an_good", ("an_fc",), """
SELECT *, coalesce(list_bool_or(list_transform(range(2, len(fc) + 1),
         lambda k: fc[k] < fc[k - 1] * 0.5 OR fc[k] > fc[k - 1] * 2.0)), false) AS is_unreliable
FROM an_fc WHERE len(fc) > 0""")
cte("an_as_of", ("an_good",), "SELECT DISTINCT ticker, last_date AS as_of FROM an_good")
cte("an_blocks", ("an_as_of", "headlines"), _blocks_sql("an_as_of", False))
cte("an_sent", ("an_good", "an_blocks"), f"""
SELECT g.*, coalesce(b.n_headlines, 0) AS n_headlines,
       CASE WHEN coalesce(b.n_headlines, 0) > 0 THEN {_writer_sql(_SYNTH)} ELSE '{K.NO_NEWS_SUMMARY}' END
         AS sentiment_summary
FROM an_good g LEFT JOIN an_blocks b ON g.ticker = b.ticker AND g.last_date = b.as_of""")

_WARNING = "'" + K.UNRELIABLE_WARNING.replace("'", "''") + "'"
_AN_REPORT = render_sql(K.ANALYST_REPORT_PROMPT, ticker="ticker",
                        warning=f"CASE WHEN is_unreliable THEN {_WARNING} ELSE '' END",
                        last_price=fmt2_sql("last_actual"), pred_days="CAST(prediction_days AS VARCHAR)",
                        forecast=_py_list_sql("fc"), sentiment="sentiment_summary")


@register("pl_analyze", f"""
SELECT request_id, ticker, 'Success' AS status, NULL AS error_message, round(last_actual, 6) AS last_actual_price,
       is_unreliable, summary, CAST(len(fc) AS BIGINT) AS n_forecast, {list_text_sql('fc')} AS forecast_text,
       last_date + 1 AS first_forecast_date, last_date + CAST(len(fc) AS INTEGER) AS last_forecast_date,
       CAST(n_headlines AS BIGINT) AS n_headlines, sentiment_summary, {_writer_sql(_AN_REPORT)} AS analyst_report
FROM an_sent
UNION ALL
SELECT r.request_id, r.ticker, 'Failure',
       CASE WHEN r.prediction_days NOT BETWEEN 1 AND 90 THEN '{K.MSG_BAD_DAYS}'
            WHEN coalesce(len(s.closes), 0) < r.context_days
              THEN 'Not enough historical data for ' || coalesce(r.ticker, '') || ' (need at least ' || CAST(r.context_days AS VARCHAR) || ' days).'
            ELSE '{K.MSG_NO_FORECAST}' END,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM rqh r LEFT JOIN series5y s ON r.ticker = s.ticker
WHERE r.request_id NOT IN (SELECT request_id FROM an_good)""", ("an_sent", "rqh", "series5y"))
def q_pl_analyze(spark, sf):
    c = Ctx(spark, sf)
    a = PL.pl_analyze(c.requests(), c.bars(), c.headlines(), *SI.MODELS)
    ok = F.col("status") == K.STATUS_OK

    def w(col):
        return F.when(ok, col)

    return a.select(
        "request_id", "ticker", "status", "error_message", w(r6("last_actual_price")).alias("last_actual_price"),
        w(F.col("is_unreliable")).alias("is_unreliable"), w(F.col("summary")).alias("summary"),
        w(F.size("forecast_prices").cast("bigint")).alias("n_forecast"),
        w(price_list_text("forecast_prices")).alias("forecast_text"),
        w(F.try_element_at("forecast_dates", F.lit(1))).alias("first_forecast_date"),
        w(F.try_element_at("forecast_dates", F.lit(-1))).alias("last_forecast_date"),
        w(F.coalesce("n_headlines", F.lit(0)).cast("bigint")).alias("n_headlines"),
        w(F.col("sentiment_summary")).alias("sentiment_summary"), w(F.col("analyst_report")).alias("analyst_report"))


# ---------------------------------------------------------------------------
# backtest
# ---------------------------------------------------------------------------

cte("bt_ok", ("rqh", "series5y"), """
SELECT r.request_id, r.ticker, r.prediction_days, r.model_days, r.context_days,
       s.closes[1 : len(s.closes) - r.prediction_days] AS ctx,
       s.closes[len(s.closes) - r.prediction_days + 1 :] AS actual,
       s.closes[len(s.closes) - r.prediction_days] AS last_ctx,
       s.dates[len(s.closes) - r.prediction_days] AS last_context_date
FROM rqh r JOIN series5y s ON r.ticker = s.ticker
WHERE r.prediction_days BETWEEN 1 AND 90 AND len(s.closes) >= r.context_days + r.prediction_days""")
cte("bt_chunks", ("bt_ok",), _chunks_sql("bt_ok", "ctx"))
cte("bt_summary", ("bt_chunks",), _summary_sql("bt_chunks"))
cte("bt_fc", ("bt_ok", "bt_summary"), f"""
SELECT *, {_drift_forecast_sql('prompt', 'last_ctx')} AS fc FROM (
  SELECT o.*, sm.summary, {_serving_prompt_sql('sm.summary', 'o.ctx', 'o.last_ctx')} AS prompt
  FROM bt_ok o JOIN bt_summary sm ON o.request_id = sm.request_id)""")
cte("bt_good", ("bt_fc",), """
SELECT *, list_transform(range(1, least(len(fc), len(actual)) + 1),
                         lambda k: {'step': k, 'f': fc[k], 'a': actual[k]}) AS pairs
FROM bt_fc WHERE len(fc) > 0""")
cte("bt_as_of", ("bt_good",), "SELECT DISTINCT ticker, last_context_date AS as_of FROM bt_good")
cte("bt_blocks", ("bt_as_of", "headlines"), _blocks_sql("bt_as_of", True))
cte("bt_sent", ("bt_good", "bt_blocks"), f"""
SELECT g.*, coalesce(b.n_headlines, 0) AS n_headlines,
       CASE WHEN coalesce(b.n_headlines, 0) > 0 THEN {_writer_sql(_SYNTH)} ELSE '{K.NO_NEWS_SUMMARY}' END
         AS sentiment_summary,
       {_MAE} AS mae, {_MAPE} AS mape, {_MSE} AS mse, sqrt({_MSE}) AS rmse, {_DA} AS da
FROM bt_good g LEFT JOIN bt_blocks b ON g.ticker = b.ticker AND g.last_context_date = b.as_of""")

_BT_REPORT = render_sql(K.ANALYST_REPORT_PROMPT, ticker="ticker", warning="''", last_price=fmt2_sql("last_ctx"),
                        pred_days="CAST(prediction_days AS VARCHAR)", forecast=_py_list_sql("fc"),
                        sentiment="sentiment_summary")
cte("bt_rep", ("bt_sent",), f"SELECT *, {_writer_sql(_BT_REPORT)} AS report FROM bt_sent")
_REVIEW = render_sql(K.REVIEW_PROMPT, ticker="ticker", report="report", forecast=_py_list_sql("fc"),
                     actual=_py_list_sql("actual"), mae=fmt2_sql("mae"), rmse=fmt2_sql("rmse"),
                     mape=fmt2_sql("mape"), da=fmt2_sql("da"), sentiment="sentiment_summary")


@register("pl_backtest", f"""
SELECT request_id, ticker, 'Success' AS status, NULL AS error_message, CAST(len(pairs) AS BIGINT) AS n_compared,
       round(mae, 6) AS mae, round(mape, 6) AS mape, round(mse, 3) AS mse, round(rmse, 6) AS rmse,
       round(da, 6) AS directional_accuracy, CAST(len(fc) AS BIGINT) AS n_forecast,
       CAST(n_headlines AS BIGINT) AS n_headlines, sentiment_summary, report AS original_analyst_report,
       {_writer_sql(_REVIEW)} AS final_test_report
FROM bt_rep
UNION ALL
SELECT r.request_id, r.ticker, 'Failure',
       CASE WHEN r.prediction_days NOT BETWEEN 1 AND 90 THEN '{K.MSG_BAD_DAYS}'
            WHEN coalesce(len(s.closes), 0) < r.context_days + r.prediction_days
              THEN 'Not enough historical data to perform backtest (need '
                   || CAST(r.context_days + r.prediction_days AS VARCHAR) || ' days).'
            ELSE '{K.MSG_NO_FORECAST}' END,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM rqh r LEFT JOIN series5y s ON r.ticker = s.ticker
WHERE r.request_id NOT IN (SELECT request_id FROM bt_good)""", ("bt_rep", "rqh", "series5y"))
def q_pl_backtest(spark, sf):
    c = Ctx(spark, sf)
    b = PL.pl_backtest(c.requests(), c.bars(), c.headlines(), *SI.MODELS)
    ok = F.col("status") == K.STATUS_OK

    def w(col):
        return F.when(ok, col)

    return b.select(
        "request_id", "ticker", "status", "error_message", w(F.col("n_compared").cast("bigint")).alias("n_compared"),
        w(r6("mae")).alias("mae"), w(r6("mape")).alias("mape"), w(F.round("mse", 3)).alias("mse"),
        w(r6("rmse")).alias("rmse"), w(r6("directional_accuracy")).alias("directional_accuracy"),
        w(F.size("forecast_prices").cast("bigint")).alias("n_forecast"),
        w(F.coalesce("n_headlines", F.lit(0)).cast("bigint")).alias("n_headlines"),
        w(F.col("sentiment_summary")).alias("sentiment_summary"),
        w(F.col("original_analyst_report")).alias("original_analyst_report"),
        w(F.col("final_test_report")).alias("final_test_report"))
