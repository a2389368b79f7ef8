"""Queries: models that raise, and the inference memo."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import unreliable_jump
from ..functions.text import fmt2, price_list_text, py_list_text, render, summary_trim
from ..operators import features as FE
from ..operators import memo as MM
from ..session import scratch_path
from . import pipelines as PL
from . import standins as SI
from .catalog import Ctx, register
from .oracle import cte
from .queries_corpus import _fold_oracle
from .queries_pipelines import _BT_REPORT, _REVIEW, _SYNTH
from .queries_serving import _REPORT_SQL


def _bad(prompt: str) -> str:
    return f"substr(md5({prompt}), 2, 1) < '4'"


def _raised(prompt: str) -> str:
    return f"CASE WHEN {_bad(prompt)} THEN 'no answer to ' || substr(md5({prompt}), 1, 8) END"


@register("pl_analyze_model_errors", f"""
SELECT request_id, 'Success' AS status, NULL AS error_message, sentiment_summary, is_unreliable
FROM an_sent WHERE NOT ({_bad('prompt')})
UNION ALL
SELECT r.request_id, 'Failure',
       CASE WHEN r.prediction_days NOT BETWEEN 1 AND 90 THEN '{K.MSG_BAD_DAYS}'
            WHEN coalesce(len(s.closes), 0) < r.context_days
              THEN 'Not enough historical data for ' || coalesce(r.ticker, '') || ' (need at least ' || CAST(r.context_days AS VARCHAR) || ' days).'
            WHEN {_bad('f.prompt')} THEN {_raised('f.prompt')} ELSE '{K.MSG_NO_FORECAST}' END, NULL, NULL
FROM rqh r LEFT JOIN series5y s ON r.ticker = s.ticker LEFT JOIN an_fc f ON r.request_id = f.request_id
WHERE r.request_id NOT IN (SELECT request_id FROM an_sent WHERE NOT ({_bad('prompt')}))""", ("an_sent", "an_fc", "rqh", "series5y"))
def q_pl_analyze_model_errors(spark, sf):
    c = Ctx(spark, sf)
    a = PL.pl_analyze(c.requests(), c.bars(), c.headlines(), SI.raising(SI.drift_forecaster), *SI.MODELS[1:])
    good = F.col("status") == K.STATUS_OK
    return a.select("request_id", "status", "error_message", F.when(good, F.col("sentiment_summary")).alias("sentiment_summary"),
                    F.when(good, F.col("is_unreliable")).alias("is_unreliable"))


cte("bt_prompts", ("bt_rep", "bt_blocks"), f"""
SELECT g.*, CASE WHEN n_headlines > 0 THEN {_SYNTH} END AS p1, {_BT_REPORT.replace("ticker", "g.ticker")} AS p2, {_REVIEW.replace("ticker", "g.ticker")} AS p3
FROM bt_rep g LEFT JOIN (SELECT ticker, as_of, headline_block FROM bt_blocks) b ON g.ticker = b.ticker AND g.last_context_date = b.as_of""")


@register("pl_backtest_model_errors", f"""
SELECT r.request_id, CASE WHEN p.request_id IS NOT NULL AND coalesce({_raised('p1')}, {_raised('p2')}, {_raised('p3')}) IS NULL THEN 'Success' ELSE 'Failure' END AS status,
       CASE WHEN p.request_id IS NOT NULL THEN coalesce({_raised('p1')}, {_raised('p2')}, {_raised('p3')})
            WHEN r.prediction_days NOT BETWEEN 1 AND 90 THEN '{K.MSG_BAD_DAYS}'
            WHEN coalesce(len(s.closes), 0) < r.context_days + r.prediction_days
              THEN 'Not enough historical data to perform backtest (need ' || CAST(r.context_days + r.prediction_days AS VARCHAR) || ' days).'
            ELSE '{K.MSG_NO_FORECAST}' END AS error_message
FROM rqh r LEFT JOIN series5y s ON r.ticker = s.ticker LEFT JOIN bt_prompts p ON r.request_id = p.request_id""", ("bt_prompts", "rqh", "series5y"))
def q_pl_backtest_model_errors(spark, sf):
    c = Ctx(spark, sf)
    forecaster, summarizer, writer, classifier = SI.MODELS
    b = PL.pl_backtest(c.requests(), c.bars(), c.headlines(), forecaster, summarizer, SI.raising(writer), classifier)
    return b.select("request_id", "status", "error_message")


@register("ud_write_text_memo", f"""
SELECT ticker, 'REPORT ' || substr(md5({_REPORT_SQL}), 1, 12) AS report, CAST(substr(ticker, 2) AS INTEGER) % 2 = 0 AS recalled
FROM (SELECT ticker, closes, closes[greatest(len(closes) - 4, 1) :] AS t FROM series5y)""", ("series5y",))
def q_ud_write_text_memo(spark, sf):
    """Reports of the tickers of even number, then of all: the second run asks the model for the others only."""
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars())).withColumn("t", FE.last_n("closes", 5))
    warning = F.when(unreliable_jump("t"), F.lit(K.UNRELIABLE_WARNING)).otherwise(F.lit(""))
    p = render(K.ANALYST_REPORT_PROMPT, ticker="ticker", warning=warning, last_price=fmt2(F.try_element_at("closes", F.lit(-1))),
               pred_days=F.lit("5"), forecast=py_list_text("t"), sentiment=F.lit(K.NO_NEWS_SUMMARY))
    asked, memo = s.select("ticker", p.alias("prompt")), scratch_path(spark, "memo")
    MM.generate(asked.where(F.substr("ticker", F.lit(2)).cast("int") % 2 == 0), "prompt", "report", SI.md5_writer, memo)
    out = MM.generate(asked, "prompt", "report", SI.md5_writer, memo, recalled_as="recalled")
    return out.select("ticker", "report", "recalled")


@register("ud_fold_summary_memo", f"""
SELECT f.ticker, f.summary, CAST(greatest(CASE WHEN n = 0 THEN 0 WHEN n <= 180 THEN 1 ELSE CAST(ceil((n - 180) / 150.0) AS BIGINT) + 1 END - 4, 0) AS BIGINT) AS n_called
FROM ({_fold_oracle()}) f JOIN (SELECT ticker, len(closes) AS n FROM series5y) s ON f.ticker = s.ticker""", ("series5y",))
def q_ud_fold_summary_memo(spark, sf):
    """The fold over each series' first four chunks, then over all: the second run goes on behind them."""
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars())).select("ticker", F.col("closes").alias("ctx"))
    chunks = FE.overlap_chunks(s, arr="ctx").select("ticker", "chunk_no", price_list_text("chunk").alias("chunk_text"))
    memo = scratch_path(spark, "memo")
    MM.ordered_fold(chunks.where("chunk_no < 4"), "ticker", "chunk_no", "chunk_text", SI.chunk_summarizer, memo)
    out = MM.ordered_fold(chunks, "ticker", "chunk_no", "chunk_text", SI.chunk_summarizer, memo)
    return out.select("ticker", summary_trim("summary").alias("summary"), "n_called")
