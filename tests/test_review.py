"""Cases that whole-table checks do not reach: caps that bind, two requests of a ticker, odd inputs, short series."""

import datetime as dt

from pyspark.sql import functions as F

from pricelab.functions import constants as K
from pricelab.functions.scalar import ticker_from_url
from pricelab.functions.text import py_list_text
from pricelab.operators import corpus as CO
from pricelab.operators import features as FE
from pricelab.operators import news as NW
from pricelab.operators.horizons import resolve_horizon
from pricelab.plans import pipelines as PL
from pricelab.plans import standins as SI

from .conftest import bars_df

NEWS = "ticker string, date date, published_at timestamp_ntz, title string, source string, lang string, relevancy long"


def news(spark, rows):
    day = lambda d: dt.datetime.combine(d, dt.time())
    return spark.createDataFrame([(t, d, day(d), title, src, "en", k) for k, (t, d, title, src) in enumerate(rows)], NEWS)


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, url string, prediction_days int")


def test_second_source_is_taken_whole_and_old_items_too(spark):
    bars = bars_df(spark, {"A": [100.0 + k % 9 for k in range(400)]})
    last = dt.date(2024, 1, 1) + dt.timedelta(days=399)
    rows = [("A", last - dt.timedelta(days=k), f"feed {k}", "pages") for k in range(45)]
    rows += [("A", last, f"search {k}", "documents") for k in range(30)] + [("A", last - dt.timedelta(days=6), "old search", "documents")]
    out = PL.pl_analyze(requests(spark, [(1, "https://q.example.com/quote/A", 5)]), bars, news(spark, rows), SI.last_value_forecaster, *SI.MODELS[1:], period=None).first()
    assert out.status == "Success" and out.n_headlines == 45 + 20


def test_backtest_requests_of_one_ticker_see_their_own_news(spark):
    bars = bars_df(spark, {"A": [100.0 + k % 9 for k in range(600)]})
    last = dt.date(2024, 1, 1) + dt.timedelta(days=599)
    rows = [("A", last - dt.timedelta(days=k), f"news {k}", src) for k in range(80) for src in ("documents",)]
    rows += [("A", last - dt.timedelta(days=40), "early feed", "pages"), ("A", last - dt.timedelta(days=2), "late feed", "pages")]
    url = "https://q.example.com/quote/A"
    both = {r.request_id: r for r in PL.pl_backtest(requests(spark, [(1, url, 1), (2, url, 30)]), bars, news(spark, rows),
                                                    SI.last_value_forecaster, *SI.MODELS[1:], period=None).collect()}
    for k, days in ((1, 1), (2, 30)):
        alone = PL.pl_backtest(requests(spark, [(k, url, days)]), bars, news(spark, rows), SI.last_value_forecaster, *SI.MODELS[1:], period=None).first()
        assert both[k].n_headlines == alone.n_headlines and both[k].sentiment_summary == alone.sentiment_summary
    assert both[1].n_headlines == 6 + 2 and both[2].n_headlines == 6 + 1
    assert both[1].sentiment_summary != both[2].sentiment_summary


def test_no_title_of_a_block_is_after_its_split(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=k), f"title {k}", "pages" if k % 2 else "documents") for k in range(60)]
    asof = spark.createDataFrame([("A", dt.date(2024, 1, 20)), ("A", dt.date(2024, 2, 20))], "ticker string, asof date")
    blocks = {r.asof: r.headline_block for r in PL._headline_blocks(news(spark, rows), asof, SI.md5_classifier, feed_bounded=True).collect()}
    for day, block in blocks.items():
        shown = [int(line.split("title ")[1].split("'")[0]) for line in block.split("\n")]
        assert shown and max(shown) <= (day - dt.date(2024, 1, 1)).days


def test_blank_titles_count_against_the_cap_and_stay_in_the_sentiment_corpus(spark):
    day = dt.date(2024, 1, 10)
    h = news(spark, [("A", day, None, "documents"), ("A", day, "", "documents")] + [("A", day, f"t{k}", "documents") for k in range(30)])
    assert NW.select_news(h, asof=day, cap=20).count() == 18
    assert NW.select_news(h, asof=day, cap=20, skip_blank=False).count() == 20
    assert NW.select_news(h, asof=day, cap=None).count() == 30


def test_horizon_table_of_any_size(spark):
    table = spark.range(1, 30_001).select((F.col("id") * 2).cast("int").alias("pred_days"), F.col("id").cast("int").alias("context_days"))
    req = requests(spark, [(1, "u", 3), (2, "u", 4), (3, "u", 60_000), (4, "u", 60_001), (5, "u", None), (6, "u", 3)])
    got = {r.request_id: (r.model_days, r.context_days) for r in resolve_horizon(req, table).collect()}
    assert got == {1: (4, 2), 2: (4, 2), 3: (60_000, 30_000), 4: (60_001, K.FALLBACK_CONTEXT_DAYS), 5: (None, K.FALLBACK_CONTEXT_DAYS), 6: (4, 2)}
    plan = resolve_horizon(req, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_bad_url_is_a_row(spark):
    df = requests(spark, [(1, "https://q.example.com/quote/BAD TICKER|x", 5), (2, "https://q.example.com/quote/OK/", 5), (3, None, 5)])
    assert [r[0] for r in df.select(ticker_from_url("url")).collect()] == [None, "OK", None]


def test_news_search_without_a_ticker(spark):
    h = spark.createDataFrame([("BRK.B up.",), ("BRKxB up",), ("^GSPC falls",), ("Acme Corp. wins",), ("the acme of it",), ("nothing",), ("about ABC.",)], "title string")
    c = spark.createDataFrame([("BRK.B", "Berkshire Hathaway"), ("^GSPC", None), ("ACM", "acme corp"), ("ABC", "Alphabet Soup")], "ticker string, name string")
    got = sorted((r.ticker, r.title) for r in NW.news_search(h, c).collect())
    assert got == [("ABC", "about ABC."), ("ACM", "Acme Corp. wins"), ("BRK.B", "BRK.B up."), ("^GSPC", "^GSPC falls")]


def test_float_text_is_plain(spark):
    values = [0.0005, 12345678.9, 1e-05, 1e16, 1.5, 100.0, 123456.789, 1e15, -0.00025, 0.0, 2.5e-07]
    got = spark.createDataFrame([(values,)], "a array<double>").select(py_list_text("a")).first()[0]
    assert got == str(values)


def test_flat_window_at_a_high_price(spark):
    closes = [300_000.0 + 100 * k for k in range(900)] + [612_345.67] * 60
    prices = bars_df(spark, {"A": closes})
    rows = CO.corpus_positions(prices, fixed=(30, 1)).where("i = 940")
    mean, std = CO.window_moments(F.col("i") - F.col("context_days"), F.col("context_days"))
    got = rows.select(mean.alias("m"), std.alias("s")).first()
    assert got.s == 0.0 and abs(got.m - 612_345.67) < 1e-9


def test_window_moments_equal_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    closes = np.round(rng.lognormal(8, 2, 400), 4).tolist()
    rows = CO.corpus_positions(bars_df(spark, {"A": closes}), fixed=(60, 5))
    mean, std = CO.window_moments(F.col("i") - F.col("context_days"), F.col("context_days"))
    for r in rows.select("i", mean.alias("m"), std.alias("s")).collect():
        w = pd.Series(closes[r.i - 60 : r.i])
        assert np.isclose(r.m, w.mean(), rtol=1e-12) and np.isclose(r.s, w.std(), rtol=1e-9)


def test_ingest_keeps_one_bar_a_day(spark):
    bars = bars_df(spark, {"A": [float(k) for k in range(1, 42)]})
    twice = bars.unionByName(bars.where(F.dayofmonth("date") <= 14).withColumn("close", F.col("close") + 0.5))
    out = FE.ingest(twice, None).orderBy("date").collect()
    assert len(out) == 41 - 19
    assert FE.one_bar_per_day(twice).count() == 41
    assert sum(r.close for r in FE.one_bar_per_day(twice).collect()) == sum(range(1, 42)) + 0.5 * sum(1 for r in bars.collect() if r.date.day <= 14)


def test_last_n_of_short_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],), ([float(k) for k in range(9)],)], "a array<double>")
    assert [r[0] for r in df.select(FE.last_n("a", 5)).collect()] == [[1.0, 2.0], [], [4.0, 5.0, 6.0, 7.0, 8.0]]
