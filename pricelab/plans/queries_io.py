"""Queries: write-read round trips of the sinks/sources, symbols, resume joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import fmt2_strict, price_list_text
from ..operators import corpus as CO
from ..operators import features as FE
from ..operators import resume as RS
from ..operators.numbering import numbered_keys
from ..session import scratch_path
from ..sources import files as IO
from ..sources import runs as RU
from ..sources import shards as SH
from ..sources import tables as T
from . import pipelines as PL
from . import standins as SI
from .catalog import Ctx, r6, register
from .oracle import bucket_sql, list_text_sql


@register("snk_price_csv", """
SELECT ticker, date, round(close, 6) AS close, round(ma_20, 6) AS ma_20 FROM prices5y""", ("prices5y",))
def q_snk_price_csv(spark, sf):
    path = scratch_path(spark, "prices-csv")
    IO.write_prices(FE.ingest(Ctx(spark, sf).bars()), path)
    back = IO.read_prices_csv(spark, path)
    return back.select("ticker", "date", r6("close").alias("close"), r6("ma_20").alias("ma_20"))


@register("src_price_csv", """
SELECT ticker, CAST(count(*) AS BIGINT) AS n_rows, round(sum(close), 2) AS sum_close FROM prices5y GROUP BY ticker""",
          ("prices5y",))
def q_src_price_csv(spark, sf):
    path = scratch_path(spark, "prices-csv")
    IO.write_prices(FE.ingest(Ctx(spark, sf).bars()), path)
    back = IO.read_prices_csv(spark, path)
    return back.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("close"), 2).alias("sum_close"))


@register("tk_sorted_universe", """
SELECT CAST(row_number() OVER (ORDER BY ticker) - 1 AS BIGINT) AS pos, ticker FROM (SELECT DISTINCT ticker FROM bars)""",
          ("bars",))
def q_tk_sorted_universe(spark, sf):
    return numbered_keys(Ctx(spark, sf).bars())


@register("snk_ticker_json", """
SELECT CAST(row_number() OVER (ORDER BY ticker) - 1 AS BIGINT) AS pos, ticker FROM (SELECT DISTINCT ticker FROM bars)""",
          ("bars",))
def q_snk_ticker_json(spark, sf):
    path = scratch_path(spark, "universe-json")
    IO.write_universe(Ctx(spark, sf).bars(), path)
    return IO.read_universe(spark, path)


@register("src_universe_json", """
SELECT CAST(row_number() OVER (ORDER BY ticker) - 1 AS BIGINT) AS pos, ticker FROM (SELECT DISTINCT ticker FROM headlines)""",
          ("headlines",))
def q_src_universe_json(spark, sf):
    path = scratch_path(spark, "universe-json")
    IO.write_universe(Ctx(spark, sf).headlines(), path)
    return IO.read_universe(spark, path)


@register("src_portfolio_json", "SELECT pos, ticker FROM portfolio", ("portfolio",))
def q_src_portfolio_json(spark, sf):
    path = scratch_path(spark, "portfolio-json")
    IO.write_portfolio(PL.pl_portfolio(Ctx(spark, sf).bars()), path)
    return IO.read_portfolio(spark, path)


def _corpus_roundtrip(spark, sf):
    from .queries_corpus import corpus_df
    path = scratch_path(spark, "corpus-jsonl")
    IO.write_corpus(corpus_df(spark, sf), path, mode="overwrite")
    return IO.read_corpus(spark, path)


@register("snk_corpus_jsonl", """
SELECT ticker, CAST(i AS BIGINT) AS i, md5(text) AS text_md5 FROM corpus""", ("corpus",))
def q_snk_corpus_jsonl(spark, sf):
    return _corpus_roundtrip(spark, sf).select("ticker", "i", F.md5("text").alias("text_md5"))


@register("src_corpus_jsonl", """
SELECT ticker, CAST(count(*) AS BIGINT) AS n_prompts, CAST(sum(context_days) AS BIGINT) AS sum_context
FROM corpus GROUP BY ticker""", ("corpus",))
def q_src_corpus_jsonl(spark, sf):
    from ..functions.text import context_tag
    back = _corpus_roundtrip(spark, sf).select("ticker", "text")  # text-only view, as the application reads it
    return back.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_prompts"),
                                      F.sum(context_tag("text")).cast("bigint").alias("sum_context"))


@register("snk_result_records", """
SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM bt_good) THEN 'Success' ELSE 'Failure' END AS status
FROM rqh""", ("bt_good", "rqh"))
def q_snk_result_records(spark, sf):
    c = Ctx(spark, sf)
    res = PL.pl_backtest(c.requests(), c.bars(), c.headlines(), *SI.MODELS)
    path = scratch_path(spark, "records")
    IO.write_records(res, path)
    back = spark.read.text(path).select(F.from_json("value", "request_id bigint, status string").alias("r"))
    return back.select("r.request_id", "r.status")


_PRICE_LINE = "CAST(date AS VARCHAR) || ' ' || printf('%.2f', open) || ' ' || printf('%.2f', high) || ' ' || printf('%.2f', low) || ' ' || printf('%.2f', close) || ' ' || printf('%.0f', volume)"


@register("snk_result_records_prices", f"""
SELECT r.request_id, r.ticker, CASE WHEN a.request_id IS NULL THEN 'Failure' ELSE 'Success' END AS status,
       CASE WHEN a.request_id IS NOT NULL THEN NULL WHEN r.prediction_days NOT BETWEEN 1 AND 90 THEN '{K.MSG_BAD_DAYS}'
            WHEN coalesce(len(s.closes), 0) < r.context_days
              THEN 'Not enough historical data for ' || coalesce(r.ticker, '') || ' (need at least ' || CAST(r.context_days AS VARCHAR) || ' days).'
            ELSE '{K.MSG_NO_FORECAST}' END AS error_message,
       a.sentiment_summary, round(a.last_actual, 6) AS last_actual_price, {list_text_sql('a.fc')} AS forecast_prices,
       CAST(a.last_date + 1 AS VARCHAR) || ' ' || CAST(a.last_date + CAST(len(a.fc) AS INTEGER) AS VARCHAR) AS forecast_dates,
       CAST(coalesce(p.n, 0) AS BIGINT) AS n_prices, p.prices_md5
FROM rqh r LEFT JOIN an_sent a ON r.request_id = a.request_id LEFT JOIN series5y s ON r.ticker = s.ticker
LEFT JOIN (SELECT ticker, count(*) AS n, md5(string_agg({_PRICE_LINE}, chr(10) ORDER BY date)) AS prices_md5 FROM prices5y GROUP BY ticker) p
  ON a.ticker = p.ticker""", ("an_sent", "rqh", "series5y", "prices5y"))
def q_snk_result_records_prices(spark, sf):
    """Analysis records with the price rows they rest on, written as JSON lines and read back."""
    c = Ctx(spark, sf)
    res = PL.pl_analyze(c.requests(), c.bars(), c.headlines(), *SI.MODELS)
    res = res.withColumn("asof", F.when(F.col("status") == K.STATUS_OK, F.date_sub(F.try_element_at("forecast_dates", F.lit(1)), 1)))
    res, path = IO.with_prices(res, FE.ingest(c.bars())), scratch_path(spark, "records")
    IO.write_records(res, path)
    back, ok = IO.read_records(spark, path, res.schema), F.col("status") == K.STATUS_OK
    line = F.transform("historical_data", lambda x: F.concat_ws(" ", x["date"].cast("string"), *[fmt2_strict(x[k]) for k in ("open", "high", "low", "close")],
                                                                F.format_string("%.0f", x["volume"].cast("double"))))
    dates = F.concat_ws(" ", F.try_element_at("forecast_dates", F.lit(1)).cast("string"), F.try_element_at("forecast_dates", F.lit(-1)).cast("string"))
    n = F.size("historical_data").cast("bigint")
    return back.select("request_id", "ticker", "status", "error_message", F.when(ok, F.col("sentiment_summary")).alias("sentiment_summary"),
                       F.when(ok, r6("last_actual_price")).alias("last_actual_price"), F.when(ok, price_list_text("forecast_prices")).alias("forecast_prices"),
                       F.when(ok, dates).alias("forecast_dates"), n.alias("n_prices"), F.when(n > 0, F.md5(F.array_join(line, "\n"))).alias("prices_md5"))


@register("src_symbols_from_pages", r"""
SELECT DISTINCT trim(s) AS symbol FROM (SELECT unnest(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a>', 1)) AS s FROM pages)
WHERE trim(s) <> ''""")
def q_src_symbols_from_pages(spark, sf):
    return IO.extract_link_texts(T.table(spark, sf, "pages", "html"))


# ---------------------------------------------------------------------------
# resume: universe minus the tickers already in an output
# ---------------------------------------------------------------------------

def _universe_and_done(spark, sf):
    c = Ctx(spark, sf)
    universe = c.bars().select("ticker").distinct()
    done = PL.pl_portfolio(c.bars()).select("ticker")  # the sentiment corpus's tickers
    return universe, done


@register("jn_resume_anti", """
SELECT DISTINCT ticker FROM bars WHERE ticker NOT IN (SELECT ticker FROM portfolio)""", ("bars", "portfolio"))
def q_jn_resume_anti(spark, sf):
    universe, done = _universe_and_done(spark, sf)
    return RS.remaining(universe, done)


@register("st_except_done", """
SELECT ticker FROM (SELECT DISTINCT ticker FROM bars) EXCEPT ALL SELECT DISTINCT ticker FROM portfolio""",
          ("bars", "portfolio"))
def q_st_except_done(spark, sf):
    universe, done = _universe_and_done(spark, sf)
    return universe.exceptAll(done.distinct())


@register("jn_resume_positional", """
SELECT pos, ticker FROM (SELECT CAST(row_number() OVER (ORDER BY ticker) - 1 AS BIGINT) AS pos, ticker
                         FROM (SELECT DISTINCT ticker FROM bars)) u
WHERE pos > coalesce((SELECT max(pos) FROM (SELECT CAST(row_number() OVER (ORDER BY ticker) - 1 AS BIGINT) AS pos, ticker
                                            FROM (SELECT DISTINCT ticker FROM bars)) x
                      WHERE ticker IN (SELECT ticker FROM portfolio WHERE side = 'volatile')), -1)""",
          ("bars", "portfolio"))
def q_jn_resume_positional(spark, sf):
    c = Ctx(spark, sf)
    uni = numbered_keys(c.bars())
    done = PL.pl_portfolio(c.bars()).where(F.col("side") == "volatile").select("ticker")
    return RS.remaining_after(uni, done)


@register("jn_resume_manifest", """
SELECT ticker, CAST(i AS BIGINT) AS i, md5(text) AS text_md5 FROM corpus""", ("corpus",))
def q_jn_resume_manifest(spark, sf):
    """A corpus run that ends after two of its four parts, then a resuming run with another cut."""
    prices, path = FE.ingest(Ctx(spark, sf).bars()), scratch_path(spark, "corpus-run")
    build = lambda some: CO.ts_corpus(prices.join(some, "ticker", "left_semi"))

    def stop(k):
        if k == 1:
            raise InterruptedError

    universe = prices.select("ticker").distinct()
    try:
        RU.run(universe, build, path, parts=4, after_part=stop)
    except InterruptedError:
        pass
    RU.run(universe, build, path, parts=3)
    return RU.corpus(spark, path).select("ticker", F.col("i").cast("bigint").alias("i"), F.md5("text").alias("text_md5"))


@register("tk_shuffle_shards", """
SELECT CAST(row_number() OVER (ORDER BY order_key, ticker, i) - 1 AS BIGINT) AS pos, ticker, CAST(i AS BIGINT) AS i
FROM (SELECT s.*, """ + bucket_sql("42", "ticker", "i", start=9) + """ AS order_key FROM split s) WHERE split = 'train'""", ("split",))
def q_tk_shuffle_shards(spark, sf):
    """The training side of the split, written as shuffled shards and read back by the index."""
    from .queries_corpus import corpus_df
    rows = PL.pl_ts_corpus_filter_split(corpus_df(spark, sf)).where("split = 'train'")
    path = scratch_path(spark, "shards")
    SH.write_shards(rows, path, shard_rows=1000, columns=("ticker", "i", "text"))
    back = SH.read_shards(spark, path, "ticker string, i bigint, text string")
    return back.select("pos", "ticker", "i")
