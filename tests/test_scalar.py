import datetime as dt

from pyspark.sql import functions as F

from pricelab.functions import scalar as S


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_ticker_from_url(spark):
    urls = ["https://q.example.com/quote/BTC-USD/", "https://q.example.com/quote/AAPL?p=AAPL",
            "https://q.example.com/quote/ONDS", "https://q.example.com/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(S.ticker_from_url("url")).collect()] == ["BTC-USD", "AAPL", "ONDS", None]
    assert [r[0] for r in df.select(S.ticker_from_url_split("url")).collect()][:3] == ["BTC-USD", "AAPL?p=AAPL", "ONDS"]


def test_trend2_flat_is_downward(spark):
    assert one(spark, S.trend2(F.lit(1.0), F.lit(1.0))) == "downward"
    assert one(spark, S.trend2(F.lit(1.0), F.lit(1.1))) == "upward"


def test_trend3(spark):
    assert one(spark, S.trend3(F.lit(100.0), F.lit(104.9))) == "stable"
    assert one(spark, S.trend3(F.lit(100.0), F.lit(105.0))) == "upward"
    assert one(spark, S.trend3(F.lit(100.0), F.lit(95.0))) == "downward"
    assert one(spark, S.trend3(F.lit(0.0), F.lit(50.0))) == "stable"  # non-positive first -> 0 %


def test_unreliable_jump(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, S.unreliable_jump(a(10, 11, 12))) is False
    assert one(spark, S.unreliable_jump(a(10, 21))) is True
    assert one(spark, S.unreliable_jump(a(10, 4.9))) is True
    assert one(spark, S.unreliable_jump(a(10))) is False


def test_forecast_dates_calendar_days(spark):
    d = one(spark, S.forecast_dates(F.lit(dt.date(2024, 1, 5)), 3))  # a Friday
    assert d == [dt.date(2024, 1, 6), dt.date(2024, 1, 7), dt.date(2024, 1, 8)]


def test_volatility_level_null_is_low(spark):
    assert one(spark, S.volatility_level(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0))) == "low"
    assert one(spark, S.volatility_level(F.lit(2.0), F.lit(1.0), F.lit(2.0))) == "high"
    assert one(spark, S.volatility_level(F.lit(1.0), F.lit(1.0), F.lit(2.0))) == "medium"


def test_period_bucket(spark):
    df = spark.createDataFrame([(c,) for c in [30, 31, 365, 1000, 1825]], "c int")
    assert [r[0] for r in df.select(S.period_bucket("c")).collect()] == ["1mo", "2mo", "1y", "3y", "5y"]
