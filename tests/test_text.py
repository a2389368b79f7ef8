from pyspark.sql import functions as F

from pricelab.functions import constants as K
from pricelab.functions import text as X


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_fmt2_matches_python(spark):
    vals = [0.125, 1.005, 2.675, 150.255, -0.001, 0.0, 123456.789, 1e-9, 99999.995]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["s"] for r in df.select(X.fmt2("x").alias("s")).collect()]
    assert got == ["%.2f" % v for v in vals]


def test_fmt2_null_is_nan(spark):
    assert one(spark, X.fmt2(F.lit(None).cast("double"))) == "nan"


def test_price_list_text(spark):
    assert one(spark, X.price_list_text(F.array(F.lit(1.0), F.lit(2.675), F.lit(10.0)))) == "1.00, 2.67, 10.00"


def test_parse_prices_quirks(spark):
    text = F.lit("PREDICTION: [3., -4.5, 1,234.5]")
    assert one(spark, X.parse_prices(text)) == [3.0, 4.5, 1.0, 234.5]
    assert one(spark, X.parse_prices(text, 2)) == [3.0, 4.5]
    assert one(spark, X.parse_prices(F.lit("no numbers"))) == []


def test_parse_prices_loose(spark):
    assert one(spark, X.parse_prices_loose(F.lit(" [1.5, 2.25]"))) == [1.5, 2.25]
    assert one(spark, X.parse_prices_loose(F.lit(" 1.2.3 and 4"))) is None


def test_after_marker(spark):
    assert one(spark, X.after_marker(F.lit("a PREDICTION: b PREDICTION: c"))) == " b "
    assert one(spark, X.after_marker(F.lit("nothing"))) is None


def test_parse_label_pair_defaults(spark):
    s, c = X.parse_label_pair(F.lit("SENTIMENT_SCORE: -0.45, NEXT_DAY_PRICE_CHANGE: 1.25%"))
    assert one(spark, s) == -0.45 and one(spark, c) == 1.25
    s, c = X.parse_label_pair(F.lit("SENTIMENT_SCORE: 1, NEXT_DAY_PRICE_CHANGE: 2%"))
    assert one(spark, s) == 0.0 and one(spark, c) == 0.0


def test_tags(spark):
    t = F.lit("STOCK: AB-C\nCONTEXT_DAYS: 60\nSTOCK: X")
    assert one(spark, X.stock_tag(t)) == "AB-C"
    assert one(spark, X.context_tag(t)) == 60
    assert one(spark, X.context_tag(F.lit("no tag"))) is None


def test_summary_trim(spark):
    assert one(spark, X.summary_trim(F.lit("Chunk 3,  the stock rose. \n"))) == "the stock rose."
    assert one(spark, X.summary_trim(F.lit("no comma here "))) == "no comma here "


def test_render_template_bytes(spark):
    col = X.render(K.TRAINING_PROMPT, ticker=F.lit("T"), mean=F.lit("1.00"), std_dev=F.lit("0.50"),
                   trend=F.lit("upward"), context_days=F.lit("2"), context=F.lit("1.00, 2.00"),
                   pred_days=F.lit("1"), target=F.lit("3.00"))
    expected = K.TRAINING_PROMPT.format(ticker="T", mean="1.00", std_dev="0.50", trend="upward",
                                        context_days="2", context="1.00, 2.00", pred_days="1", target="3.00")
    assert one(spark, col) == expected
