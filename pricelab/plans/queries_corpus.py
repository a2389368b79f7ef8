"""Queries: sliding-window corpus, text rendering, filters, counts and the split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import trend2
from ..functions.text import price_list_text, render
from ..operators import corpus as CO
from ..operators import features as FE
from . import pipelines as PL
from .catalog import Ctx, r6, register
from .oracle import bucket_sql, cte, fmt2_sql, list_text_sql, render_sql, window_mean_sql, window_std_sql

_PREDS = ", ".join(str(p) for p, _ in K.CORPUS_HORIZONS)
_CTXS = ", ".join(str(c) for _, c in K.CORPUS_HORIZONS)

cte("positions5y", ("series5y",), f"""
SELECT ticker, closes, n, i,
       [{_PREDS}][k] AS pred_days, [{_CTXS}][k] AS context_days
FROM (SELECT ticker, closes, n, i,
             CAST({bucket_sql('42', 'ticker', 'i')} % {len(K.CORPUS_HORIZONS)} + 1 AS INTEGER) AS k
      FROM (SELECT ticker, closes, len(closes) AS n, unnest(range(len(closes))) AS i FROM series5y))""")


def _corpus_sql(rows: str, template: str) -> str:
    text = render_sql(template, ticker="ticker", mean=fmt2_sql("mean"), std_dev=fmt2_sql("std"),
                      trend="CASE WHEN ctx[-1] > ctx[1] THEN 'upward' ELSE 'downward' END",
                      context_days="CAST(context_days AS VARCHAR)", context=list_text_sql("ctx"),
                      pred_days="CAST(pred_days AS VARCHAR)", target=list_text_sql("tgt"))
    return f"""
SELECT ticker, i, pred_days, context_days, {text} AS text
FROM (SELECT ticker, i, pred_days, context_days,
             closes[i - context_days + 1 : i] AS ctx, closes[i + 1 : i + pred_days] AS tgt,
             {window_mean_sql('i - context_days', 'context_days')} AS mean,
             {window_std_sql('i - context_days', 'context_days')} AS std
      FROM {rows} WHERE i >= context_days AND i + pred_days <= n)"""


cte("corpus", ("positions5y",), _corpus_sql("positions5y", K.TRAINING_PROMPT))

cte("positions_all", ("series_all",), f"""
SELECT ticker, closes, n, i,
       [{_PREDS}][k] AS pred_days, [{_CTXS}][k] AS context_days
FROM (SELECT ticker, closes, n, i,
             CAST({bucket_sql('42', 'ticker', 'i')} % {len(K.CORPUS_HORIZONS)} + 1 AS INTEGER) AS k
      FROM (SELECT ticker, closes, len(closes) AS n, unnest(range(len(closes))) AS i FROM series_all))""")
cte("corpus_all", ("positions_all",), _corpus_sql("positions_all", K.TRAINING_PROMPT))

cte("fixed_positions", ("series5y",), """
SELECT ticker, closes, n, i, 5 AS pred_days, 60 AS context_days
FROM (SELECT ticker, closes, len(closes) AS n, unnest(range(len(closes))) AS i FROM series5y)""")
cte("fixed_corpus", ("fixed_positions",), _corpus_sql("fixed_positions", K.FIXED_WINDOW_PROMPT))

cte("short_positions", ("series5y",), """
SELECT ticker, closes, n, i, 1 AS pred_days, 30 AS context_days
FROM (SELECT ticker, closes, len(closes) AS n, unnest(range(len(closes))) AS i FROM series5y)""")
cte("short_corpus", ("short_positions",), _corpus_sql("short_positions", K.TRAINING_PROMPT))

_KEYS = "ticker, CAST(i AS BIGINT) AS i, CAST(pred_days AS BIGINT) AS pred_days, " \
        "CAST(context_days AS BIGINT) AS context_days"


def _keys(df):
    return df.select("ticker", F.col("i").cast("bigint").alias("i"), F.col("pred_days").cast("bigint").alias("pred_days"),
                     F.col("context_days").cast("bigint").alias("context_days"), *[c for c in df.columns if c not in
                                                                                  ("ticker", "i", "pred_days", "context_days")])


def corpus_df(spark, sf):
    return PL.pl_ts_corpus(Ctx(spark, sf).bars())


@register("pl_ts_corpus", f"SELECT {_KEYS}, md5(text) AS text_md5 FROM corpus", ("corpus",))
def q_pl_ts_corpus(spark, sf):
    c = corpus_df(spark, sf)
    return _keys(c.select("ticker", "i", "pred_days", "context_days", F.md5("text").alias("text_md5")))


@register("wn_window_choice", f"""
SELECT ticker, CAST(i AS BIGINT) AS i, CAST(pred_days AS BIGINT) AS pred_days,
       CAST(context_days AS BIGINT) AS context_days FROM positions5y""", ("positions5y",))
def q_wn_window_choice(spark, sf):
    p = FE.with_position(FE.ingest(Ctx(spark, sf).bars()))
    return _keys(CO.choose_window(p, 42).select("ticker", "i", "pred_days", "context_days"))


@register("sc_training_prompt", f"SELECT {_KEYS}, text FROM short_corpus", ("short_corpus",))
def q_sc_training_prompt(spark, sf):
    c = CO.ts_corpus(FE.ingest(Ctx(spark, sf).bars()), fixed=(30, 1))
    return _keys(c)


@register("wn_fixed_window", f"SELECT {_KEYS}, md5(text) AS text_md5 FROM fixed_corpus", ("fixed_corpus",))
def q_wn_fixed_window(spark, sf):
    c = CO.fixed_window_corpus(FE.ingest(Ctx(spark, sf).bars()))
    return _keys(c.select("ticker", "i", "pred_days", "context_days", F.md5("text").alias("text_md5")))


@register("sc_price_list_text", f"""
SELECT ticker, md5({list_text_sql('closes')}) AS closes_text_md5, CAST(len(closes) AS BIGINT) AS n
FROM series5y""", ("series5y",))
def q_sc_price_list_text(spark, sf):
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars()))
    return s.select("ticker", F.md5(price_list_text("closes")).alias("closes_text_md5"),
                    F.size("closes").cast("bigint").alias("n"))


@register("sc_trend2", """
SELECT ticker, CASE WHEN closes[-1] > closes[1] THEN 'upward' ELSE 'downward' END AS trend FROM series5y""",
          ("series5y",))
def q_sc_trend2(spark, sf):
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars()))
    return s.select("ticker", trend2(F.try_element_at("closes", F.lit(1)), F.try_element_at("closes", F.lit(-1))).alias("trend"))


@register("wn_context_frame", """
SELECT ticker, date, CAST(count(close) OVER w AS BIGINT) AS n_ctx,
       md5(coalesce(array_to_string(list_transform(list(close) OVER w, lambda x: printf('%.2f', x)), ', '), '')) AS ctx_md5
FROM prices5y WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
          ("prices5y",))
def q_wn_context_frame(spark, sf):
    p = FE.context_frame(FE.ingest(Ctx(spark, sf).bars()), 60)
    return p.select("ticker", "date", F.size("context").cast("bigint").alias("n_ctx"),
                    F.md5(price_list_text("context")).alias("ctx_md5"))


@register("wn_target_frame", """
SELECT ticker, date, CAST(count(close) OVER w AS BIGINT) AS n_tgt,
       array_to_string(list_transform(list(close) OVER w, lambda x: printf('%.2f', x)), ', ') AS tgt_text
FROM prices5y WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""",
          ("prices5y",))
def q_wn_target_frame(spark, sf):
    p = FE.target_frame(FE.ingest(Ctx(spark, sf).bars()), 5)
    return p.select("ticker", "date", F.size("target").cast("bigint").alias("n_tgt"),
                    price_list_text("target").alias("tgt_text"))


@register("ag_context_stats", f"""
SELECT ticker, CAST(i AS BIGINT) AS i, CAST(context_days AS BIGINT) AS n,
       round({window_mean_sql('i - context_days', 'context_days')}, 6) AS mean,
       round({window_std_sql('i - context_days', 'context_days')}, 6) AS std,
       round(closes[i - context_days + 1], 6) AS first, round(closes[i], 6) AS last
FROM positions5y WHERE i >= context_days AND i + pred_days <= n""", ("positions5y",))
def q_ag_context_stats(spark, sf):
    rows = CO.corpus_positions(FE.ingest(Ctx(spark, sf).bars()))
    start0 = F.col("i") - F.col("context_days")
    mean, std = CO.window_moments(start0, F.col("context_days"))
    return rows.select("ticker", F.col("i").cast("bigint").alias("i"), F.col("context_days").cast("bigint").alias("n"),
                       r6(mean).alias("mean"), r6(std).alias("std"),
                       r6(F.try_element_at("closes", start0 + 1)).alias("first"),
                       r6(F.try_element_at("closes", F.col("i"))).alias("last"))


@register("flt_context_len", f"SELECT {_KEYS} FROM corpus WHERE context_days <= {K.MAX_CONTEXT_DAYS_FILTER}",
          ("corpus",))
def q_flt_context_len(spark, sf):
    return _keys(CO.filter_context(corpus_df(spark, sf)).select("ticker", "i", "pred_days", "context_days"))


@register("sc_extract_tags", """
SELECT ticker, CAST(i AS BIGINT) AS i, regexp_extract(text, 'STOCK: (\\S+)', 1) AS stock_tag,
       CAST(regexp_extract(text, 'CONTEXT_DAYS: (\\d+)', 1) AS BIGINT) AS context_tag
FROM corpus""", ("corpus",))
def q_sc_extract_tags(spark, sf):
    from ..functions.text import context_tag, stock_tag
    c = corpus_df(spark, sf)
    return c.select("ticker", F.col("i").cast("bigint").alias("i"), stock_tag("text").alias("stock_tag"),
                    context_tag("text").cast("bigint").alias("context_tag"))


@register("ag_corpus_counts", f"""
SELECT ticker, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE context_days <= {K.MAX_CONTEXT_DAYS_FILTER}) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE context_days > {K.MAX_CONTEXT_DAYS_FILTER}) AS BIGINT) AS dropped
FROM corpus GROUP BY ROLLUP (ticker)""", ("corpus",))
def q_ag_corpus_counts(spark, sf):
    return CO.corpus_counts(corpus_df(spark, sf))


cte("split", ("corpus",), f"""
SELECT ticker, i, pred_days, context_days,
       CASE WHEN NOT is_eval THEN 'train'
            WHEN row_number() OVER (PARTITION BY is_eval ORDER BY order_key, ticker, i) <= {K.EVAL_CAP} THEN 'eval'
            ELSE 'eval_overflow' END AS split
FROM (SELECT *, {bucket_sql('42', 'ticker', 'i')} % 10000 < {int(K.EVAL_FRACTION * 10000)} AS is_eval,
             {bucket_sql('42', 'ticker', 'i', start=9)} AS order_key
      FROM corpus WHERE context_days <= {K.MAX_CONTEXT_DAYS_FILTER})""")


@register("tk_shuffle_split", f"SELECT {_KEYS}, split FROM split", ("split",))
def q_tk_shuffle_split(spark, sf):
    s = PL.pl_ts_corpus_filter_split(corpus_df(spark, sf))
    return _keys(s.select("ticker", "i", "pred_days", "context_days", "split"))


@register("pl_ts_corpus_filter_split", """
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(context_days) AS BIGINT) AS sum_context
FROM split GROUP BY split""", ("split",))
def q_pl_ts_corpus_filter_split(spark, sf):
    s = PL.pl_ts_corpus_filter_split(corpus_df(spark, sf))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("context_days").cast("bigint").alias("sum_context"))


@register("wn_overlap_chunks", f"""
SELECT ticker, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(len(chunk) AS BIGINT) AS n,
       round(chunk[1], 6) AS first, round(chunk[-1], 6) AS last
FROM (SELECT ticker, chunk_no, ctx[chunk_no * 150 + 1 : chunk_no * 150 + 180] AS chunk
      FROM (SELECT ticker, ctx, unnest(range(CASE WHEN len(ctx) = 0 THEN 0 WHEN len(ctx) <= 180 THEN 1
                                              ELSE CAST(ceil((len(ctx) - 180) / 150.0) AS BIGINT) + 1 END)) AS chunk_no
            FROM (SELECT ticker, closes AS ctx FROM series5y)))""",
          ("series5y",))
def q_wn_overlap_chunks(spark, sf):
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars()))
    s = s.select("ticker", F.col("closes").alias("ctx"))
    ch = FE.overlap_chunks(s, arr="ctx")
    return ch.select("ticker", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                     F.size("chunk").cast("bigint").alias("n"), r6(F.try_element_at("chunk", F.lit(1))).alias("first"),
                     r6(F.try_element_at("chunk", F.lit(-1))).alias("last"))


def _fold_oracle() -> str:
    # closed form of the chunk_summarizer fold: count of chunks with >= 31 closes,
    # text of the last such chunk; trimmed after the first comma
    return """
SELECT ticker,
       CASE WHEN m = 0 THEN 'No significant trend observed yet.'
            ELSE CAST(last_n AS VARCHAR) || ' closes from ' || printf('%.2f', last_first) || ' to '
                 || printf('%.2f', last_last) || '.' END AS summary
FROM (SELECT ticker, count(*) FILTER (WHERE len(chunk) >= 31) AS m,
             arg_max(len(chunk), chunk_no) FILTER (WHERE len(chunk) >= 31) AS last_n,
             arg_max(chunk[1], chunk_no) FILTER (WHERE len(chunk) >= 31) AS last_first,
             arg_max(chunk[-1], chunk_no) FILTER (WHERE len(chunk) >= 31) AS last_last
      FROM (SELECT ticker, chunk_no, ctx[chunk_no * 150 + 1 : chunk_no * 150 + 180] AS chunk
            FROM (SELECT ticker, ctx, unnest(range(CASE WHEN len(ctx) = 0 THEN 0 WHEN len(ctx) <= 180 THEN 1
                                    ELSE CAST(ceil((len(ctx) - 180) / 150.0) AS BIGINT) + 1 END)) AS chunk_no
                  FROM (SELECT ticker, closes AS ctx FROM series5y)))
      GROUP BY ticker)"""


@register("wn_ordered_fold", _fold_oracle(), ("series5y",))
def q_wn_ordered_fold(spark, sf):
    from ..functions.text import summary_trim
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars()))
    s = s.select("ticker", F.col("closes").alias("ctx"))
    ch = FE.overlap_chunks(s, arr="ctx")
    arr = ch.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("_c"))
    folded = arr.select("ticker", PL.fold_sql_chunk_summarizer(F.col("_c.chunk")).alias("summary"))
    return folded.select("ticker", summary_trim("summary").alias("summary"))


@register("ud_fold_summary", _fold_oracle(), ("series5y",))
def q_ud_fold_summary(spark, sf):
    from ..functions.text import summary_trim
    from . import standins as SI
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars()))
    s = s.select("ticker", F.col("closes").alias("ctx"))
    ch = FE.overlap_chunks(s, arr="ctx").withColumn("chunk_text", price_list_text("chunk"))
    out = PL.ordered_fold(ch, "ticker", "chunk_no", "chunk_text", SI.chunk_summarizer)
    return out.select("ticker", summary_trim("summary").alias("summary"))


@register("sc_summary_prompt", """
SELECT ticker, CAST(chunk_no AS BIGINT) AS chunk_no, md5(""" + render_sql(
    K.SUMMARIZER_PROMPT, prior="'No significant trend observed yet.'",
    chunk=list_text_sql("chunk")) + """) AS prompt_md5
FROM (SELECT ticker, chunk_no, ctx[chunk_no * 150 + 1 : chunk_no * 150 + 180] AS chunk
      FROM (SELECT ticker, ctx, unnest(range(CASE WHEN len(ctx) = 0 THEN 0 WHEN len(ctx) <= 180 THEN 1
                              ELSE CAST(ceil((len(ctx) - 180) / 150.0) AS BIGINT) + 1 END)) AS chunk_no
            FROM (SELECT ticker, closes AS ctx FROM series5y)))""",
          ("series5y",))
def q_sc_summary_prompt(spark, sf):
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars()))
    s = s.select("ticker", F.col("closes").alias("ctx"))
    ch = FE.overlap_chunks(s, arr="ctx")
    p = render(K.SUMMARIZER_PROMPT, prior=F.lit(K.INITIAL_SUMMARY), chunk=price_list_text("chunk"))
    return ch.select("ticker", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5(p).alias("prompt_md5"))


@register("wn_tail_n", """
SELECT ticker, date, round(close, 6) AS close FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices5y) WHERE rn <= 180""",
          ("prices5y",))
def q_wn_tail_n(spark, sf):
    t = FE.tail_n(FE.ingest(Ctx(spark, sf).bars()), K.FINAL_CONTEXT_ROWS)
    return t.select("ticker", "date", r6("close").alias("close"))


@register("wn_holdout_split", """
SELECT ticker, date, CASE WHEN rn <= h THEN 'truth' ELSE 'context' END AS part FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.ticker ORDER BY p.date DESC) AS rn, r.prediction_days AS h
  FROM prices5y p JOIN requests r ON p.ticker = 'B' || CAST(r.request_id AS VARCHAR))""",
          ("prices5y", "requests"))
def q_wn_holdout_split(spark, sf):
    c = Ctx(spark, sf)
    r = c.requests().select(F.concat(F.lit("B"), F.col("request_id").cast("string")).alias("ticker"),
                            F.col("prediction_days").alias("h"))
    p = FE.ingest(c.bars()).join(r, "ticker")
    return FE.holdout_split(p, "h").select("ticker", "date", "part")


@register("wn_one_shot_example", """
SELECT ticker, CASE WHEN len(closes) - 10 >= 60 THEN """ + list_text_sql("closes[len(closes) - 10 - 59 : len(closes) - 10]") + """ END AS example_context,
       CASE WHEN len(closes) - 10 >= 60 THEN """ + list_text_sql("closes[len(closes) - 9 : len(closes)]") + """ END AS example_target
FROM (SELECT ticker, closes[1 : len(closes) - 10] AS closes FROM series5y)""", ("series5y",))
def q_wn_one_shot_example(spark, sf):
    from ..operators.backtest import one_shot_example
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars()))
    s = s.select("ticker", F.slice("closes", F.lit(1), F.greatest(F.size("closes") - 10, F.lit(0))).alias("ctx"))
    ex_c, ex_t = one_shot_example(F.col("ctx"), 10)
    return s.select("ticker", price_list_text(ex_c).alias("example_context"),
                    price_list_text(ex_t).alias("example_target"))


@register("wn_step_ratio", """
SELECT ticker, CAST(k AS BIGINT) AS step, round(closes[k + 1] / closes[k], 6) AS ratio,
       round(closes[k + 1] - closes[k], 6) AS delta
FROM (SELECT ticker, closes, unnest(range(1, len(closes))) AS k FROM series5y)""", ("series5y",))
def q_wn_step_ratio(spark, sf):
    from ..functions.scalar import step_delta, step_ratio
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars()))
    z = s.select("ticker", F.posexplode(F.arrays_zip(step_ratio("closes").alias("ratio"),
                                                     step_delta("closes").alias("delta"))).alias("k", "z"))
    return z.select("ticker", (F.col("k") + 1).cast("bigint").alias("step"), r6("z.ratio").alias("ratio"),
                    r6("z.delta").alias("delta"))
