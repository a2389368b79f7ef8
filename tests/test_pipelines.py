import datetime as dt

from pricelab.functions import constants as K
from pricelab.plans import pipelines as PL
from pricelab.plans import standins as SI

from .conftest import bars_df


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, url string, prediction_days int")


def no_news(spark):
    return spark.createDataFrame([], "ticker string, date date, published_at timestamp, title string, "
                                     "source string, lang string, relevancy long")


def test_analyze_error_rows_and_success(spark):
    closes = [100.0 + (k % 9) for k in range(400)]
    bars = bars_df(spark, {"AAA": closes, "SHORT": closes[:50]})
    req = requests(spark, [(1, "https://q.example.com/quote/AAA/", 5),
                           (2, "https://q.example.com/quote/AAA", 95),
                           (3, "https://q.example.com/quote/SHORT", 30),
                           (4, "https://q.example.com/quote/NONE", 1)])
    out = {r.request_id: r for r in PL.pl_analyze(req, bars, no_news(spark), SI.last_value_forecaster, *SI.MODELS[1:],
                                                  period=None).collect()}
    assert out[2].status == "Failure" and out[2].error_message == K.MSG_BAD_DAYS
    assert out[3].error_message == "Not enough historical data for SHORT (need at least 365 days)."
    assert out[4].error_message == "Not enough historical data for NONE (need at least 30 days)."
    ok = out[1]
    assert ok.status == "Success" and ok.error_message is None
    assert ok.forecast_prices == [float("%.2f" % closes[-1])] * 5
    last = dt.date(2024, 1, 1) + dt.timedelta(days=399)
    assert ok.forecast_dates == [last + dt.timedelta(days=k) for k in range(1, 6)]
    assert ok.sentiment_summary == K.NO_NEWS_SUMMARY  # no headlines: default sentence, still a success
    assert ok.analyst_report.startswith("REPORT ") and ok.is_unreliable is False


def test_backtest_metrics_and_truncation(spark):
    closes = [100.0 + (k % 13) for k in range(300)]
    bars = bars_df(spark, {"AAA": closes})
    req = requests(spark, [(1, "https://q.example.com/quote/AAA", 7), (2, "https://q.example.com/quote/AAA", 90)])
    out = {r.request_id: r for r in PL.pl_backtest(req, bars, no_news(spark), SI.last_value_forecaster, *SI.MODELS[1:],
                                                   period=None).collect()}
    r = out[1]
    assert r.status == "Success" and r.n_compared == 7
    assert r.actual_prices == closes[-7:]
    last_ctx = closes[-8]
    assert r.last_price_in_context == last_ctx
    assert abs(r.mae - sum(abs(float("%.2f" % last_ctx) - a) for a in closes[-7:]) / 7) < 1e-9
    assert out[2].error_message == "Not enough historical data to perform backtest (need 1090 days)."


def test_ordered_fold_matches_sql_fold(spark):
    from pyspark.sql import functions as F

    from pricelab.functions.text import price_list_text
    from pricelab.operators import features as FE

    closes = [50.0 + (k * 7 % 23) for k in range(700)]
    s = FE.series_arrays(bars_df(spark, {"A": closes, "B": closes[:200], "C": closes[:20]}))
    ch = FE.overlap_chunks(s).withColumn("chunk_text", price_list_text("chunk"))
    udf_fold = {r.ticker: r.summary for r in PL.ordered_fold(ch, "ticker", "chunk_no", "chunk_text",
                                                               SI.chunk_summarizer).collect()}
    arr = ch.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c"))
    sql_fold = {r.ticker: r.s for r in arr.select("ticker", PL.fold_sql_chunk_summarizer(F.col("c.chunk")).alias("s")).collect()}
    assert udf_fold == sql_fold
    assert sql_fold["C"] == K.INITIAL_SUMMARY and sql_fold["A"].startswith("Chunk 5,")


def test_backtest_strict_length_mismatch(spark):
    closes = [100.0 + (k % 13) for k in range(300)]
    bars = bars_df(spark, {"AAA": closes})
    req = requests(spark, [(1, "https://q.example.com/quote/AAA", 7)])

    def short_forecaster():
        return lambda prompts: [" [1.00, 2.00]" for _ in prompts]

    loose = PL.pl_backtest(req, bars, no_news(spark), short_forecaster, *SI.MODELS[1:], period=None).first()
    assert loose.status == "Success" and loose.n_compared == 2
    strict = PL.pl_backtest(req, bars, no_news(spark), short_forecaster, *SI.MODELS[1:], period=None, strict=True).first()
    assert strict.status == "Failure" and strict.error_message == "Forecast has 2 prices but the holdout has 7."
