"""Queries: Structured Streaming jobs checked against their batch equivalents."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.text import price_list_text, summary_trim
from ..operators import features as FE
from ..session import scratch_path
from ..streaming import jobs as S
from . import standins as SI
from .catalog import Ctx, register
from .queries_corpus import _fold_oracle


@register("sm_incremental_corpus", """
SELECT ticker, CAST(i AS BIGINT) AS i, CAST(pred_days AS BIGINT) AS pred_days,
       CAST(context_days AS BIGINT) AS context_days, md5(text) AS text_md5 FROM corpus_all""", ("corpus_all",))
def q_sm_incremental_corpus(spark, sf):
    base = scratch_path(spark, "stream-corpus")
    inp, out, ck = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    bars = Ctx(spark, sf).bars()
    month = F.date_format("date", "yyyy-MM")
    # deliveries cut by month: run 1 gets every month but the latest; run 2 gets the latest
    # month late, plus a second copy of an early month
    last = bars.select(F.max(month)).scalar()
    first = bars.select(F.min(month)).scalar()
    bars.where(month != last).repartition(month).write.parquet(os.path.join(inp, "d1"))
    S.incremental_corpus(spark, inp, out, ck)
    bars.where(month == last).write.parquet(os.path.join(inp, "d2"))
    bars.where(month == first).write.parquet(os.path.join(inp, "d3"))
    S.incremental_corpus(spark, inp, out, ck)
    c = S.corpus_view(spark, out)
    return c.select("ticker", F.col("i").cast("bigint").alias("i"), F.col("pred_days").cast("bigint").alias("pred_days"),
                    F.col("context_days").cast("bigint").alias("context_days"), F.md5("text").alias("text_md5"))


@register("sm_headline_dedupe", """
SELECT DISTINCT ticker, title FROM headlines WHERE title IS NOT NULL""", ("headlines",))
def q_sm_headline_dedupe(spark, sf):
    base = scratch_path(spark, "stream-news")
    a, b, out, ck = (os.path.join(base, x) for x in ("pages", "documents", "out", "ckpt"))
    h = Ctx(spark, sf).headlines().where(F.col("title").isNotNull())
    for part in (1, 0, 3, 2, 1):  # by weeks, out of order, one delivered twice
        h = h.withColumn("part", F.floor(F.datediff(F.lit("2001-11-04"), "date") / 7) % 4)
        cut = h.where(F.col("part") == part).drop("part")
        cut.where(F.col("source") == "pages").write.mode("append").parquet(a)
        cut.where(F.col("source") == "documents").write.mode("append").parquet(b)
        S.headline_dedupe(spark, [a, b], out, ck, buckets=8)
    return S.distinct_titles(spark, out).select("ticker", "title")


@register("sm_rolling_summary", _fold_oracle(), ("series5y",))
def q_sm_rolling_summary(spark, sf):
    base = scratch_path(spark, "stream-summary")
    inp, out, ck = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    s = FE.series_arrays(FE.ingest(Ctx(spark, sf).bars()))
    s = s.select("ticker", F.col("closes").alias("ctx"))
    ch = FE.overlap_chunks(s, arr="ctx").select("ticker", "chunk_no", price_list_text("chunk").alias("chunk_text"))
    for part in (2, 0, 3, 1):  # out of order, and the first part twice
        ch.where(F.col("chunk_no") % 4 == part).write.parquet(os.path.join(inp, f"d{part}"))
        S.rolling_summary(spark, inp, out, ck, SI.chunk_summarizer)
    ch.where(F.col("chunk_no") % 4 == 2).write.parquet(os.path.join(inp, "again"))
    S.rolling_summary(spark, inp, out, ck, SI.chunk_summarizer)
    return S.latest_summaries(spark, out).select("ticker", summary_trim("summary").alias("summary"))
