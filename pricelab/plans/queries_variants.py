"""Queries: further variants of prompts and parsers, and caps small enough to bind on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import loose_forecast_text, py_list_text, render
from ..operators import corpus as CO
from ..operators import features as FE
from ..operators import models as M
from ..operators import news as NW
from . import pipelines as PL
from . import standins as SI
from .catalog import Ctx, register
from .oracle import bucket_sql, cte, fmt2_sql, list_text_sql, mean_sql, render_sql, std_sql
from .queries_corpus import _KEYS, _corpus_sql, _keys, corpus_df
from .queries_news import _LINE_SQL, ASOF_SQL, _asof
from .queries_serving import _py_list_sql, _responses

CONTEXT_CAP, EVAL_CAP, NEWS_CAP = 90, 10, 4

cte("every_position", ("series5y",), f"""
SELECT ticker, closes, n, i, pred_days, context_days
FROM (SELECT ticker, closes, len(closes) AS n, unnest(range(len(closes))) AS i FROM series5y),
     (VALUES {", ".join(str(h) for h in K.CORPUS_HORIZONS)}) AS h(pred_days, context_days)""")
cte("every_corpus", ("every_position",), _corpus_sql("every_position", K.TRAINING_PROMPT))


@register("sc_training_prompt_windows", f"SELECT {_KEYS}, md5(text) AS text_md5 FROM every_corpus", ("every_corpus",))
def q_sc_training_prompt_windows(spark, sf):
    c = CO.ts_corpus(FE.ingest(Ctx(spark, sf).bars()), every=True)
    return _keys(c.select("ticker", "i", "pred_days", "context_days", F.md5("text").alias("text_md5")))


@register("sc_label_prompt_score", f"""
SELECT ticker, source, relevancy, md5({render_sql(K.SCORE_PROMPT, headline="coalesce(title, 'None')")}) AS prompt_md5 FROM headlines""",
          ("headlines",))
def q_sc_label_prompt_score(spark, sf):
    p = render(K.SCORE_PROMPT, headline=F.coalesce("title", F.lit("None")))
    return Ctx(spark, sf).headlines().select("ticker", "source", "relevancy", F.md5(p).alias("prompt_md5"))


@register("sc_parse_prices_loose_status", rf"""
SELECT request_id, CASE WHEN bad THEN '{K.MSG_LOOSE_PARSE}' ELSE {_py_list_sql("list_transform(toks, lambda t: TRY_CAST(t AS DOUBLE))")} END AS forecast
FROM (SELECT *, toks IS NULL OR coalesce(list_bool_or(list_transform(toks, lambda t: TRY_CAST(t AS DOUBLE) IS NULL)), false) AS bad
      FROM (SELECT request_id, regexp_extract_all(string_split(text, 'PREDICTION:')[2], '[\d\.]+') AS toks FROM responses))""", ("responses",))
def q_sc_parse_prices_loose_status(spark, sf):
    return _responses(Ctx(spark, sf)).select("request_id", loose_forecast_text("text").alias("forecast"))


_TAIL = "closes[greatest(len(closes) - 4, 1) :]"
_DATA_SQL = render_sql(K.EXPLORATION_DATA, ticker="ticker", pred_days="'5'", forecast=_py_list_sql(_TAIL), analyses="analyses")


@register("sc_report_prompts_exploration", f"""
SELECT ticker, md5({render_sql(K.EXPLORATION_REPORT_PROMPT, data=_DATA_SQL)}) AS prompt_md5
FROM (SELECT s.ticker, s.closes, coalesce(l.analyses, '') AS analyses FROM series5y s LEFT JOIN (
        SELECT ticker, string_agg('- ' || line || chr(10), '' ORDER BY date, title, line) AS analyses
        FROM (SELECT ticker, date, title, {_LINE_SQL} AS line FROM (
                SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY relevancy, title) AS rn FROM headlines
                WHERE lang = 'en' AND date >= {ASOF_SQL} - 5 AND date <= {ASOF_SQL})
              WHERE rn <= 20 AND title IS NOT NULL AND title <> '') GROUP BY ticker) l ON s.ticker = l.ticker)""",
          ("series5y", "headlines", "bars"))
def q_sc_report_prompts_exploration(spark, sf):
    c = Ctx(spark, sf)
    news = NW.select_news(c.headlines(), asof=_asof(c), days=K.NEWS_LOOKBACK_DAYS, lang="en", cap=K.NEWS_CAP)
    block = NW.headline_block(M.classify(news, "title", "_lab", SI.md5_classifier)).select("ticker", "headline_block")
    s = FE.series_arrays(FE.ingest(c.bars())).join(block, "ticker", "left")
    analyses = F.coalesce(F.split("headline_block", "\n"), F.array().cast("array<string>"))
    p = PL.exploration_report_prompt("ticker", F.lit("5"), py_list_text(FE.last_n("closes", 5)), analyses)
    return s.select("ticker", F.md5(p).alias("prompt_md5"))


def _draft_sql(template: str) -> str:
    return "md5(" + render_sql(template, ticker="ticker", summary="summary", mean=fmt2_sql(mean_sql("t")), std_dev=fmt2_sql(std_sql("t")),
                               trend="CASE WHEN t[-1] > t[1] THEN 'upward' ELSE 'downward' END", context_days="CAST(len(t) AS VARCHAR)",
                               context=list_text_sql("t"), pred_days="'5'") + ")"


@register("wn_ordered_fold_draft", f"""
SELECT ticker, coalesce(summary, '{K.FALLBACK_SUMMARY}') AS summary,
       CASE WHEN summary IS NULL THEN {_draft_sql(K.DRAFT_FALLBACK_PROMPT)} ELSE {_draft_sql(K.DRAFT_SUMMARY_PROMPT)} END AS prompt_md5
FROM (SELECT s.ticker, s.closes[greatest(len(s.closes) - 179, 1) :] AS t, f.summary FROM series5y s LEFT JOIN (
        SELECT ticker, arg_max('From ' || {fmt2_sql("chunk[1]")} || chr(10) || 'to ' || {fmt2_sql("chunk[-1]")} || '.', chunk_no)
               FILTER (WHERE CAST(replace({fmt2_sql("chunk[-1]")}, '.', '') AS BIGINT) % 8 = 0) AS summary
        FROM (SELECT ticker, chunk_no, closes[chunk_no * 150 + 1 : chunk_no * 150 + 180] AS chunk
              FROM (SELECT ticker, closes, unnest(range(CASE WHEN len(closes) = 0 THEN 0 WHEN len(closes) <= 180 THEN 1
                                      ELSE CAST(ceil((len(closes) - 180) / 150.0) AS BIGINT) + 1 END)) AS chunk_no FROM series5y))
        GROUP BY ticker) f ON s.ticker = f.ticker)""", ("series5y",))
def q_wn_ordered_fold_draft(spark, sf):
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars())).select("ticker", "closes")
    return PL.draft_forecast_prompts(s, SI.draft_summarizer, 5).select("ticker", "summary", F.md5("prompt").alias("prompt_md5"))


@register("flt_context_len_binding", f"SELECT {_KEYS} FROM corpus WHERE context_days <= {CONTEXT_CAP}", ("corpus",))
def q_flt_context_len_binding(spark, sf):
    return _keys(CO.filter_context(corpus_df(spark, sf), CONTEXT_CAP).select("ticker", "i", "pred_days", "context_days"))


@register("tk_shuffle_split_binding", f"""
SELECT {_KEYS}, CASE WHEN NOT is_eval THEN 'train'
                     WHEN row_number() OVER (PARTITION BY is_eval ORDER BY order_key, ticker, i) <= {EVAL_CAP} THEN 'eval'
                     ELSE 'eval_overflow' END AS split
FROM (SELECT *, {bucket_sql('42', 'ticker', 'i')} % 10000 < {int(K.EVAL_FRACTION * 10000)} AS is_eval,
             {bucket_sql('42', 'ticker', 'i', start=9)} AS order_key
      FROM corpus WHERE context_days <= {CONTEXT_CAP})""", ("corpus",))
def q_tk_shuffle_split_binding(spark, sf):
    s = PL.pl_ts_corpus_filter_split(corpus_df(spark, sf), max_days=CONTEXT_CAP, eval_cap=EVAL_CAP)
    return _keys(s.select("ticker", "i", "pred_days", "context_days", "split"))


@register("tk_news_cap_binding", f"""
SELECT ticker, date, source, relevancy FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY relevancy, title) AS rn FROM headlines
  WHERE lang = 'en' AND date >= {ASOF_SQL} - 30)
WHERE rn <= {NEWS_CAP} AND title IS NOT NULL AND title <> ''""", ("headlines", "bars"))
def q_tk_news_cap_binding(spark, sf):
    c = Ctx(spark, sf)
    s = NW.select_news(c.headlines(), asof=_asof(c), days=K.CORPUS_NEWS_LOOKBACK_DAYS, lang="en", cap=NEWS_CAP, bounded=False)
    return s.select("ticker", "date", "source", "relevancy")
