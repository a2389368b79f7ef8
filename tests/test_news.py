import datetime as dt

from pyspark.sql import functions as F

from pricelab.operators import news as NW

from .conftest import bars_df

D = dt.date


def headlines(spark, rows):
    return spark.createDataFrame(
        [(t, d, dt.datetime.combine(d, dt.time(h)), title, src, "en", rel) for t, d, h, title, src, rel in rows],
        "ticker string, date date, published_at timestamp, title string, source string, lang string, relevancy long")


def test_same_day_next_day_and_asof(spark):
    # trading days Mon 2024-01-01 .. Fri 2024-01-05, then Mon 2024-01-08
    bars = bars_df(spark, {"T": [10.0, 11.0, 12.0, 13.0, 14.0, 15.0]}, start="2024-01-01", skip_weekends=True)
    h = headlines(spark, [("T", D(2024, 1, 3), 9, "mid week", "a", 1),
                          ("T", D(2024, 1, 6), 9, "saturday", "a", 2),
                          ("T", D(2024, 1, 8), 9, "last day", "a", 3)])
    same = {r.title for r in NW.join_news_prices(h, bars).collect()}
    assert same == {"mid week", "last day"}  # weekend news dropped
    nxt = {r.title: r.next_day_change for r in NW.next_day_change(h, bars).collect()}
    assert set(nxt) == {"mid week"}  # last trading day has no next bar
    assert abs(nxt["mid week"] - (13.0 / 12.0 - 1) * 100) < 1e-12
    fwd = {r.title: (r.next_date, r.next_close) for r in NW.asof_forward(h, bars).collect()}
    assert fwd["saturday"] == (D(2024, 1, 8), 15.0)
    assert fwd["mid week"] == (D(2024, 1, 4), 13.0)  # strictly after, not the same-day bar
    assert fwd["last day"] == (None, None)


def test_blank_titles_and_dedupe(spark):
    h = headlines(spark, [("T", D(2024, 1, 3), 12, "dup", "pages", 5),
                          ("T", D(2024, 1, 3), 8, "dup", "documents", 9),
                          ("T", D(2024, 1, 3), 8, "", "documents", 1),
                          ("T", D(2024, 1, 3), 8, None, "documents", 2)])
    assert NW.non_blank(h).count() == 2
    u = NW.union_headlines(h.where("source = 'pages'"), h.where("source = 'documents'")).where("title = 'dup'")
    r = u.collect()
    assert len(r) == 1 and r[0].source == "documents"  # earliest publication wins


def test_select_news_cap_and_lookback(spark):
    rows = [("T", D(2024, 1, 10) - dt.timedelta(days=k % 8), 1, f"t{k}", "documents", k) for k in range(40)]
    h = headlines(spark, rows)
    s = NW.select_news(h, asof=D(2024, 1, 10), days=5, cap=20).collect()
    assert len(s) == 20 and all(D(2024, 1, 5) <= r.date <= D(2024, 1, 10) for r in s)
    assert sorted(r.relevancy for r in s) == sorted(r[5] for r in rows if D(2024, 1, 5) <= r[1])[:20]


def test_quota_is_a_column(spark):
    rows = [("T", D(2024, 1, 2), 1, f"a{k}", "d", k) for k in range(30)] + \
           [("T", D(2024, 1, 3), 1, f"b{k}", "d", k) for k in range(30)]
    h = headlines(spark, rows).withColumn("volatility", F.when(F.col("date") == D(2024, 1, 2), "low").otherwise("medium"))
    q = NW.quota_news(h, NW.quota_by_level(F.col("volatility")), 50)
    got = {r.date: r["count"] for r in q.groupBy("date").count().collect()}
    assert got == {D(2024, 1, 2): 10, D(2024, 1, 3): 25}


def test_levels_default_low(spark):
    bars = bars_df(spark, {"T": [10.0, 12.0, 9.0, 9.5, 15.0, 14.0]})
    lv = NW.volatility_levels(bars)
    h = headlines(spark, [("T", D(2023, 1, 1), 1, "old", "a", 1), ("T", D(2024, 1, 5), 1, "x", "a", 2)])
    got = {r.title: r.volatility for r in NW.attach_level(h, lv).collect()}
    assert got["old"] == "low"
