"""Composite jobs: ingest, corpora, portfolio, analyse and backtest -- all tickers at once.

Each function takes DataFrames and returns a DataFrame; nothing is collected.
Models are injected as factories (see ``operators.models``).

Partitioning: the per-ticker series (``series_arrays``) is the unit of work.
It is one row per ticker holding at most one close per day of the period, so a
hot ticker cannot grow a row beyond the calendar. Requests join it on ticker;
AQE's skew-join split handles a ticker requested by many rows. Model calls run
only on rows that have not already failed (errors are rows, unioned back).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import forecast_dates, ticker_from_url, trend2, trend3, unreliable_jump
from ..functions.text import fmt2, parse_prices, price_list_text, py_list_text, render, summary_trim
from ..operators import backtest as BT
from ..operators import models as M
from ..operators.corpus import array_moments, corpus_counts, filter_context, split_corpus, ts_corpus
from ..operators.features import ingest, last_n, overlap_chunks, series_arrays
from ..operators.horizons import resolve_horizon, validate_requests
from ..operators.news import (headline_block, next_day_change, non_blank, quota_by_level, quota_news, select_news, union_headlines,
                              volatility_levels)
from ..operators.portfolio import annual_volatility, interleave, select_portfolio

# ---------------------------------------------------------------------------
# ingest, corpora, portfolio
# ---------------------------------------------------------------------------


def pl_ingest(bars: DataFrame, period: str = "5y", asof=None) -> DataFrame:
    """Trailing period -> MA20 -> drop incomplete (``ticker, date, OHLCV, ma_20``)."""
    return ingest(bars, period, asof)


def _asof_col(bars: DataFrame, asof):
    """The run's as-of date: given (str / date / Column) or the latest bar (scalar subquery)."""
    if asof is None:
        return bars.select(F.max("date")).scalar()
    return asof if isinstance(asof, Column) else F.to_date(F.lit(str(asof)))


def pl_ts_corpus(bars: DataFrame, seed: int = 42, period: str = "5y", done: DataFrame | None = None,
                 asof=None) -> DataFrame:
    """Sliding-window prompt corpus over every ticker; ``done`` (an existing corpus)
    turns it into a resume: tickers already present are skipped (anti join)."""
    prices = ingest(bars, period, asof)
    if done is not None:
        prices = prices.join(done.select("ticker").distinct(), "ticker", "left_anti")
    return ts_corpus(prices, seed=seed)


def pl_ts_corpus_filter_split(corpus: DataFrame, max_days: int = K.MAX_CONTEXT_DAYS_FILTER,
                              eval_fraction: float = K.EVAL_FRACTION, seed: int = K.SPLIT_SEED,
                              eval_cap: int = K.EVAL_CAP) -> DataFrame:
    """Filter by context length, then label the train / eval split."""
    return split_corpus(filter_context(corpus, max_days), eval_fraction, seed, eval_cap)


def pl_corpus_counts(corpus: DataFrame) -> DataFrame:
    return corpus_counts(corpus)


def pl_portfolio(bars: DataFrame, period: str = "2y", asof=None) -> DataFrame:
    """``(pos, side, ticker, volatility)`` -- 8 most and 7 least volatile tickers."""
    return select_portfolio(annual_volatility(ingest(bars, period, asof)))


def pl_sentiment_corpus(bars: DataFrame, headlines: DataFrame, scorer: Callable,
                        portfolio: DataFrame | None = None, price_period: str = "3mo",
                        news_days: int = K.CORPUS_NEWS_LOOKBACK_DAYS, news_cap: int = K.CORPUS_NEWS_CAP,
                        done: DataFrame | None = None, asof=None) -> DataFrame:
    """Headline -> (sentiment score, actual next-day change) training samples.

    portfolio (interleaved order) -> last ``price_period`` of bars -> headlines of
    the last ``news_days`` (English, top ``news_cap`` by relevancy) -> same-day
    join -> next trading close -> model score -> sample text.
    """
    if portfolio is None:
        portfolio = pl_portfolio(bars, asof=asof)
    order = interleave(portfolio).select("ticker", "order_no")
    order = order.groupBy("ticker").agg(F.min("order_no").alias("order_no"))
    if done is not None:
        order = order.join(done.select("ticker").distinct(), "ticker", "left_anti")
    prices = ingest(bars, price_period, asof).join(order, "ticker", "left_semi")
    h = headlines.join(order, "ticker", "inner")
    h = select_news(h, asof=_asof_col(bars, asof), days=news_days, lang="en", cap=news_cap, bounded=False, skip_blank=False)
    j = next_day_change(h, prices)
    j = j.withColumn("_prompt", render(K.LABEL_PROMPT, headline=F.coalesce("title", F.lit("None"))))
    j = M.generate(M.spread(j), "_prompt", "_answer", scorer, "error_message")
    score = F.coalesce(F.nullif(F.regexp_extract("_answer", K.RE_SENTIMENT, 1), F.lit("")).try_cast("double"),
                       F.lit(0.0))
    j = j.withColumn("sentiment_score", F.when(F.col("error_message").isNull(), score))  # no answer: neither score nor text
    text = render(K.SENTIMENT_SAMPLE, headline=F.coalesce("title", F.lit("None")),
                  score=fmt2("sentiment_score"), change=fmt2("next_day_change"))
    return j.select("ticker", "order_no", "date", "relevancy", "title", "sentiment_score", "next_day_change",
                    F.when(F.col("error_message").isNull(), text).alias("text"), "error_message")


def pl_volatility_news(bars: DataFrame, headlines: DataFrame, days: int = 29, period: str = "3mo",
                       mode: str = "level", asof=None) -> DataFrame:
    """Per trading day quota of headlines by that day's volatility.

    ``mode='level'``: low/medium/high -> 10/25/50 over the last ``days`` days.
    ``mode='flag'``: 50 on volatile days else 10 over the last 5 trading days.
    """
    prices = ingest(bars, period, asof)
    lv = volatility_levels(prices)
    if mode == "level":
        days_df = lv.where(F.col("date") >= F.date_sub(_asof_col(bars, asof), days))
        quota = quota_by_level(F.col("volatility"))
        max_q = max(n for _, n in K.VOLATILITY_TO_ARTICLE_COUNT)
    else:
        from pyspark.sql import Window
        w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
        days_df = lv.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 5).drop("_r")
        quota = F.when(F.col("is_volatile"), F.lit(K.VOLATILE_DAY_QUOTA)).otherwise(F.lit(K.CALM_DAY_QUOTA))
        max_q = K.VOLATILE_DAY_QUOTA
    d = days_df.select("ticker", "date", "volatility", "is_volatile")
    h = headlines.where(F.col("lang") == "en").join(d, ["ticker", "date"], "inner")
    q = quota_news(h, quota, max_q)
    return q.select("ticker", "date", "volatility", "is_volatile", "title", "relevancy",
                    F.col("_quota").cast("bigint").alias("quota"))


# ---------------------------------------------------------------------------
# ordered fold (rolling summary)
# ---------------------------------------------------------------------------

def ordered_fold(chunks: DataFrame, key: str, order: str, text: str, factory: Callable,
                 init: str = K.INITIAL_SUMMARY, template: str = K.SUMMARIZER_PROMPT) -> DataFrame:
    """(key, summary, error): ``s = model(template(prior=s, chunk=text))`` over chunks in order; empty outputs ignored.

    Sequential within a key, parallel across keys: ``groupBy(key).applyInPandas``.
    A group holds one series' chunks (bounded by the series length). A step whose
    model raises ends its key: no summary, and what it raised.
    """
    key_type, name = dict(chunks.dtypes)[key], M.model_id(factory)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s, error = init, None
        for t in pdf.sort_values(order)[text].tolist():
            s, error = M.fold_step(name, factory, template.format(prior=s, chunk=t), s)
            if error:
                break
        return pd.DataFrame({key: [pdf[key].iloc[0]], "summary": [None if error else s], "error": [error]})

    rows = M.spread(chunks.select(key, order, text), key)  # one model call per chunk: keep the width
    return rows.groupBy(key).applyInPandas(fold, f"{key} {key_type}, summary string, error string")


def draft_forecast_prompts(series: DataFrame, summarizer: Callable, pred_days: int) -> DataFrame:
    """(ticker, summary, error, prompt) of ``series(ticker, closes)``: the draft's forecast prompt with the folded summary.

    Of each answer only what stands between the summary's and the prediction's marker is taken, an answer without
    both leaves the summary as it is. A series none of whose chunks gave a summary gets the simple prompt instead.
    A model that raises gives neither summary nor prompt.
    """
    chunks = overlap_chunks(series).select("ticker", "chunk_no", price_list_text("chunk").alias("chunk_text"))
    folded = ordered_fold(chunks, "ticker", "chunk_no", "chunk_text", M.parsed_answers(summarizer, K.RE_DRAFT_SUMMARY))
    df = series.join(folded, "ticker", "left").withColumn("_f", last_n("closes", K.FINAL_CONTEXT_ROWS))
    mean, std = array_moments(F.col("_f"))
    ends = F.try_element_at("_f", F.lit(1)), F.try_element_at("_f", F.lit(-1))
    values = dict(ticker="ticker", mean=fmt2(mean), std_dev=fmt2(std), trend=trend2(*ends), context_days=F.size("_f").cast("string"),
                  context=price_list_text("_f"), pred_days=F.lit(str(pred_days)))
    none = F.col("error").isNull() & F.coalesce(F.col("summary") == K.INITIAL_SUMMARY, F.lit(True))
    prompt = (F.when(none, render(K.DRAFT_FALLBACK_PROMPT, **values))
              .when(F.col("error").isNull(), render(K.DRAFT_SUMMARY_PROMPT, summary="summary", **values)))
    return df.select("ticker", F.when(none, F.lit(K.FALLBACK_SUMMARY)).otherwise(F.col("summary")).alias("summary"), "error", prompt.alias("prompt"))


def exploration_report_prompt(ticker: str, pred_days: Column, forecast: Column, analyses: Column) -> Column:
    """The exploration notebook's report prompt: a forecast (text) and the answers on single headlines (array of texts)."""
    lines = F.array_join(F.transform(analyses, lambda a: render(K.EXPLORATION_ANALYSIS, analysis=a)), "")
    data = render(K.EXPLORATION_DATA, ticker=ticker, pred_days=pred_days, forecast=forecast, analyses=lines)
    return render(K.EXPLORATION_REPORT_PROMPT, data=data)


def fold_sql_chunk_summarizer(chunks: Column, init: str = K.INITIAL_SUMMARY) -> Column:
    """The ``chunk_summarizer`` stand-in as a SQL ``aggregate`` (same result as the UDF fold)."""

    def step(acc, ch):
        n = F.size(ch)
        k = F.coalesce(F.regexp_extract(acc, r"^Chunk (\d+),", 1).try_cast("int"), F.lit(0)) + 1
        out = F.concat(F.lit("Chunk "), k.cast("string"), F.lit(", "), n.cast("string"), F.lit(" closes from "),
                       fmt2(F.try_element_at(ch, F.lit(1))), F.lit(" to "), fmt2(F.try_element_at(ch, F.lit(-1))), F.lit("."))
        return F.when(n >= 31, out).otherwise(acc)

    return F.aggregate(chunks, F.lit(init), step)


# ---------------------------------------------------------------------------
# analyse / backtest
# ---------------------------------------------------------------------------


def _headline_blocks(headlines: DataFrame, asof_by_ticker: DataFrame, classifier: Callable,
                     days: int = K.NEWS_LOOKBACK_DAYS, cap: int = K.NEWS_CAP, bounded: bool = True,
                     feed_bounded: bool = False) -> DataFrame:
    """``(ticker, asof, n_headlines, headline_block)`` for every row of ``asof_by_ticker(ticker, asof)``.

    Two sources: ``documents`` (search API) is look-back filtered and capped;
    of ``pages`` (quote-page feed) every item is taken, for a backtest up to the
    as-of date (``feed_bounded``). Unioned and de-duplicated by title, labelled
    by the classifier, and joined into one bulleted block sorted by (date, title).
    Everything is keyed by (ticker, as-of), so two requests of one ticker see
    each its own news.
    """
    keys = ("ticker", "asof")
    h = headlines.join(asof_by_ticker, "ticker", "inner")
    a = select_news(h.where(F.col("source") == "documents"), asof=F.col("asof"), days=days, lang="en",
                    cap=cap, bounded=bounded, keys=keys)
    b = non_blank(h.where(F.col("source") == "pages"))
    if feed_bounded:
        b = b.where(F.col("date") <= F.col("asof"))
    u = union_headlines(a.select(*keys, "title", "published_at", "date"),
                        b.select(*keys, "title", "published_at", "date"), keys=(*keys, "title"))
    return headline_block(M.classify(M.spread(u), "title", "_lab", classifier), keys=keys, error="news_error")


def _written_by(df: DataFrame, prompt: Column, out: str, writer: Callable) -> DataFrame:
    """``out``: the writer's text, trimmed. A row that has failed asks nothing; a model's exception fails its row."""
    df = df.withColumn("_p", F.when(F.col("error_message").isNull(), prompt))
    df = M.generate(df, "_p", out, writer, "_e")
    return df.withColumn(out, F.trim(out)).withColumn("error_message", F.coalesce("error_message", "_e")).drop("_p", "_e")


def _sentiment_summary(df: DataFrame, writer: Callable) -> DataFrame:
    """Model summary of the headline block; the default sentence when there is none.

    One pass: rows without headlines get a NULL prompt, which the UDF skips.
    """
    has = F.coalesce(F.col("n_headlines"), F.lit(0)) > 0
    prompt = F.when(has, render(K.SENTIMENT_SYNTHESIS_PROMPT, ticker="ticker", headlines="headline_block"))
    df = _written_by(M.spread(df), prompt, "_ss", writer)
    return df.withColumn("sentiment_summary", F.when(has, F.col("_ss")).otherwise(F.lit(K.NO_NEWS_SUMMARY))).drop("_ss", "headline_block")


def _materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    Used right after model calls: the outputs feed several branches (success
    rows, failure rows, reports) and must not be recomputed per branch, nor
    re-inferred when an executor is lost.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def price_slices(prices: DataFrame, width: int | None = None) -> DataFrame:
    """A table of per-ticker series (closes, dates, n, last_date), bucketed by ticker in the scratch folder.

    Joined on ``ticker``, its side needs no exchange: what is asked comes to the
    buckets, and slices are taken where the series lie.
    """
    from ..session import scratch_path
    spark = prices.sparkSession
    width = width or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = series_arrays(prices, with_dates=True).withColumn("n", F.size("closes")).repartition(width, "ticker")
    path = scratch_path(spark, "series")
    name = "series_" + path.rsplit("-", 1)[1]
    s.write.bucketBy(width, "ticker").sortBy("ticker").option("path", path).saveAsTable(name)
    return spark.table(name)


JOB = ("ticker", "prediction_days")


def _prepare(requests: DataFrame, bars: DataFrame, period: str, asof) -> tuple[DataFrame, DataFrame]:
    """(requests with ticker, horizon and the length of their history; the table of series). Requests stay narrow."""
    r = resolve_horizon(validate_requests(requests).withColumn("ticker", ticker_from_url("url")))
    series = price_slices(ingest(bars, period, asof))
    # two plain exchanges of narrow rows: a ticker that very many ask is split by adaptive execution
    sizes = series.select("ticker", "n", "last_date").repartition(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return r.join(sizes, "ticker", "left").withColumn("n", F.coalesce("n", F.lit(0))), series


def _jobs(ok: DataFrame) -> DataFrame:
    """What is to be computed: requests of one ticker and horizon share one job, so a ticker has 90 at most."""
    return ok.select(*JOB, "model_days", "context_days", "n").distinct().withColumn("job", F.concat_ws("|", *JOB))


def _forecast(jobs: DataFrame, series: DataFrame, ctx: Column, summarizer, forecaster) -> DataFrame:
    """Rolling summary over the chunks of ``ctx``, serving prompt on its last 180 rows, model, parse.

    ``ctx`` is a slice of the joined series' closes. The series is joined where chunks and prompts are made; what is
    exchanged afterwards is text and narrow rows.
    """
    closes = series.select("ticker", "closes")
    chunks = overlap_chunks(jobs.join(closes, "ticker").select("job", ctx.alias("_ctx")), arr="_ctx", keys=("job",))
    chunks = chunks.select("job", "chunk_no", price_list_text("chunk").alias("chunk_text"))
    summ = ordered_fold(chunks, "job", "chunk_no", "chunk_text", summarizer).withColumnRenamed("error", "error_message")
    df = jobs.join(summ, "job", "left").withColumn("summary", summary_trim(F.coalesce("summary", F.lit(K.INITIAL_SUMMARY))))
    df = df.join(closes, "ticker").withColumn("_final", last_n(ctx, K.FINAL_CONTEXT_ROWS))
    mean, std = array_moments(F.col("_final"))
    df = (df.withColumn("_mean", mean).withColumn("_std", std).withColumn("last_price", F.try_element_at("_final", F.lit(-1)))
          .withColumn("trend", trend3(F.try_element_at("_final", F.lit(1)), F.try_element_at("_final", F.lit(-1)))))
    prompt = render(K.SERVING_PROMPT, summary="summary", ticker="ticker", last_price=fmt2("last_price"),
                    mean=fmt2("_mean"), std_dev=fmt2("_std"), trend="trend",
                    context_days=F.size("_final").cast("string"), context=price_list_text("_final"),
                    pred_days=F.col("model_days").cast("string"))
    df = df.select("job", *JOB, "summary", "last_price", "error_message", F.when(F.col("error_message").isNull(), prompt).alias("prompt"))
    df = M.generate(M.spread(df), "prompt", "forecast_text", forecaster, "_e").withColumn("error_message", F.coalesce("error_message", "_e"))
    df = df.withColumn("forecast_prices", parse_prices("forecast_text", F.col("prediction_days")))
    none = (F.size("forecast_prices") == 0) | F.col("forecast_prices").isNull()
    df = df.withColumn("error_message", F.coalesce("error_message", F.when(none, F.lit(K.MSG_NO_FORECAST))))
    return _materialize(df.withColumn("is_unreliable", unreliable_jump("forecast_prices")).drop("_e", "prompt", "forecast_text"))


def _results(failed: DataFrame, ok: DataFrame, done: DataFrame, cols: list[str]) -> DataFrame:
    """One row a request: those that failed before any model, and the others with their job's results."""
    keep = [c for c in ok.columns if c not in done.columns or c in JOB]
    both = ok.select(*keep).join(done, list(JOB)).unionByName(failed, allowMissingColumns=True)
    status = F.when(F.col("error_message").isNull(), F.lit(K.STATUS_OK)).otherwise(F.lit(K.STATUS_FAIL))
    return both.withColumn("status", status).select(*cols)


def pl_analyze(requests: DataFrame, bars: DataFrame, headlines: DataFrame,
               forecaster: Callable, summarizer: Callable, writer: Callable, classifier: Callable,
               period: str = "5y", asof=None) -> DataFrame:
    """One result row per request (failures included; a model's exception is one)."""
    df, series = _prepare(requests, bars, period, asof)
    not_enough = F.format_string(K.MSG_NOT_ENOUGH.replace("{ticker}", "%s").replace("{need}", "%d"),
                                 F.coalesce("ticker", F.lit("")), F.col("context_days"))
    df = _materialize(df.withColumn("error_message", F.coalesce("error_message", F.when(F.col("n") < F.col("context_days"), not_enough))))
    failed = df.where(F.col("error_message").isNotNull())
    ok = df.where(F.col("error_message").isNull())
    done = _forecast(_jobs(ok), series, last_n(F.col("closes"), F.col("context_days")), summarizer, forecaster)
    done = done.join(series.select("ticker", "last_date"), "ticker")
    good = done.where(F.col("error_message").isNull())
    blocks = _headline_blocks(headlines, good.select("ticker", F.col("last_date").alias("asof")).distinct(), classifier)
    good = good.join(blocks.withColumnRenamed("asof", "last_date"), ["ticker", "last_date"], "left")
    good = _sentiment_summary(good.withColumn("error_message", F.col("news_error")), writer)
    warning = F.when(F.col("is_unreliable"), F.lit(K.UNRELIABLE_WARNING)).otherwise(F.lit(""))
    report = render(K.ANALYST_REPORT_PROMPT, ticker="ticker", warning=warning, last_price=fmt2("last_price"),
                    pred_days=F.col("prediction_days").cast("string"), forecast=py_list_text("forecast_prices"), sentiment="sentiment_summary")
    good = _written_by(good, report, "analyst_report", writer)
    good = good.withColumn("forecast_dates", forecast_dates("last_date", F.size("forecast_prices")))
    done = good.unionByName(done.where(F.col("error_message").isNotNull()), allowMissingColumns=True).withColumnRenamed("last_price", "last_actual_price")
    cols = ["request_id", "url", "ticker", "prediction_days", "model_days", "context_days", "status",
            "error_message", "last_actual_price", "is_unreliable", "summary", "forecast_prices",
            "forecast_dates", "n_headlines", "sentiment_summary", "analyst_report"]
    return _results(failed, ok, done, cols)


def pl_backtest(requests: DataFrame, bars: DataFrame, headlines: DataFrame,
                forecaster: Callable, summarizer: Callable, writer: Callable, classifier: Callable,
                period: str = "5y", asof=None, allow_lookahead: bool = False, strict: bool = False) -> DataFrame:
    """Hold out the last ``prediction_days`` rows, forecast them, score the forecast.

    Forecast and holdout are paired step by step and truncated to the shorter
    list (``n_compared``); ``strict=True`` turns a length mismatch into an
    error row instead. A model's exception is its requests' error row.
    """
    df, series = _prepare(requests, bars, period, asof)
    need = F.col("context_days") + F.col("prediction_days")
    msg = F.format_string(K.MSG_NOT_ENOUGH_BACKTEST.replace("{need}", "%d"), need)
    df = _materialize(df.withColumn("error_message", F.coalesce("error_message", F.when(F.col("n") < need, msg))))
    failed = df.where(F.col("error_message").isNotNull())
    ok = df.where(F.col("error_message").isNull())
    split_at = F.size("closes") - F.col("prediction_days")
    done = _forecast(_jobs(ok), series, F.slice("closes", F.lit(1), split_at), summarizer, forecaster)
    # the holdout, at most 90 closes, is fetched when the forecast is there
    done = done.join(series.select("ticker", "closes", "dates"), "ticker")
    done = (done.withColumn("actual_prices", F.slice("closes", split_at + 1, F.col("prediction_days")))
            .withColumn("last_context_date", F.try_element_at("dates", split_at)).drop("closes", "dates"))
    if strict:
        mismatch = F.size("forecast_prices") != F.size("actual_prices")
        msg_len = F.format_string(K.MSG_LENGTH_MISMATCH.replace("{f}", "%d").replace("{a}", "%d"),
                                  F.size("forecast_prices"), F.size("actual_prices"))
        done = done.withColumn("error_message", F.coalesce("error_message", F.when(mismatch, msg_len)))
    good = done.where(F.col("error_message").isNull())
    good = good.withColumn("_pairs", BT.pair_arrays("forecast_prices", "actual_prices"))
    for name, c in BT.forecast_error("_pairs").items():
        good = good.withColumn(name, c)
    good = good.withColumn("directional_accuracy", BT.directional_accuracy("_pairs")).drop("_pairs")
    blocks = _headline_blocks(headlines, good.select("ticker", F.col("last_context_date").alias("asof")).distinct(),
                              classifier, bounded=not allow_lookahead, feed_bounded=not allow_lookahead)
    good = good.join(blocks.withColumnRenamed("asof", "last_context_date"), ["ticker", "last_context_date"], "left")
    good = _sentiment_summary(good.withColumn("error_message", F.col("news_error")), writer)
    report = render(K.ANALYST_REPORT_PROMPT, ticker="ticker", warning=F.lit(""), last_price=fmt2("last_price"),
                    pred_days=F.col("prediction_days").cast("string"), forecast=py_list_text("forecast_prices"), sentiment="sentiment_summary")
    good = _written_by(good, report, "original_analyst_report", writer)
    review = render(K.REVIEW_PROMPT, ticker="ticker", report="original_analyst_report", forecast=py_list_text("forecast_prices"),
                    actual=py_list_text("actual_prices"), mae=fmt2("mae"), rmse=fmt2("rmse"), mape=fmt2("mape"),
                    da=fmt2("directional_accuracy"), sentiment="sentiment_summary")
    good = _written_by(good, review, "final_test_report", writer)
    done = good.unionByName(done.where(F.col("error_message").isNotNull()), allowMissingColumns=True).withColumnRenamed("last_price", "last_price_in_context")
    cols = ["request_id", "url", "ticker", "prediction_days", "model_days", "context_days", "status",
            "error_message", "last_price_in_context", "is_unreliable", "summary", "forecast_prices",
            "actual_prices", "n_compared", "mae", "mape", "mse", "rmse", "directional_accuracy",
            "n_headlines", "sentiment_summary", "original_analyst_report", "final_test_report"]
    return _results(failed, ok, done, cols)
