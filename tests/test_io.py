import os

import pytest
from pyspark.sql import functions as F

from pricelab.session import scratch_path
from pricelab.sources import files as IO

from .conftest import bars_df


def test_corpus_jsonl_tolerant_and_strict(spark):
    path = scratch_path(spark, "jsonl")
    os.makedirs(path)
    with open(os.path.join(path, "part.json"), "w") as f:
        f.write('{"text": "STOCK: A\\nCONTEXT_DAYS: 30 ok"}\n')
        f.write('{"text": "broken\n')
        f.write('{"other": 1}\n')
        f.write('{"text": "no tags at all"}\n')
    ok = IO.read_corpus(spark, path)
    assert sorted(r.text for r in ok.collect()) == ["STOCK: A\nCONTEXT_DAYS: 30 ok", "no tags at all"]
    with pytest.raises(Exception):
        IO.read_corpus(spark, path, tolerant=False).collect()


def test_price_csv_round_trip_both_layouts(spark):
    df = bars_df(spark, {"A": [1.0, 2.0], "B": [3.0]}).withColumn("ma_20", F.lit(0.0))
    path = scratch_path(spark, "csv")
    IO.write_prices(df, path)
    back = {(r.ticker, r.close) for r in IO.read_prices_csv(spark, path).collect()}
    assert back == {("A", 1.0), ("A", 2.0), ("B", 3.0)}
    flat = scratch_path(spark, "flat")
    os.makedirs(flat)
    with open(os.path.join(flat, "BTC-USD_processed_data.csv"), "w") as f:
        f.write("date,open,high,low,close,volume,ma_20\n2024-01-02,1,1,1,5.5,1,5\n")
    r = IO.read_prices_csv(spark, flat, layout="files").first()
    assert r.ticker == "BTC-USD" and r.close == 5.5


def test_universe_abort_and_missing(spark):
    empty = spark.createDataFrame([], "ticker string")
    path = scratch_path(spark, "uni")
    assert IO.write_universe(empty, path) is False and not os.path.exists(path)
    assert IO.read_universe(spark, path).count() == 0
    uni = spark.createDataFrame([("B",), ("A",), ("B",)], "ticker string")
    assert IO.write_universe(uni, path) is True
    assert [(r.pos, r.ticker) for r in IO.read_universe(spark, path).orderBy("pos").collect()] == [(0, "A"), (1, "B")]


def test_link_texts(spark):
    pages = spark.createDataFrame([('<ul><li><a href="/x"> AAPL </a></li><li><a>  </a></li><li><a>MSFT</a></li></ul>',),
                                   ('<li><a href="/y">AAPL</a></li>',)], "html string")
    assert sorted(r.symbol for r in IO.extract_link_texts(pages).collect()) == ["AAPL", "MSFT"]


def test_price_csv_drops_malformed_rows(spark):
    flat = scratch_path(spark, "flat-bad")
    os.makedirs(flat)
    with open(os.path.join(flat, "X_processed_data.csv"), "w") as f:
        f.write("date,open,high,low,close,volume,ma_20\n2024-01-02,1,1,1,5.5,1,5\n2024-01-03,1,1,1,oops,1,5\n")
    rows = IO.read_prices_csv(spark, flat, layout="files").collect()
    assert [(r.ticker, r.close) for r in rows] == [("X", 5.5)]
    df = IO.read_prices_csv(spark, flat, layout="files")
    assert df.select("ticker").count() == 1  # not a matter of the columns asked for
    bad = IO.read_prices_csv(spark, flat, layout="files", keep_corrupt=True).where("corrupt_record is not null").collect()
    assert len(bad) == 1 and "oops" in bad[0].corrupt_record


def test_price_csv_of_the_vendor_layout(spark):
    flat = scratch_path(spark, "flat-vendor")
    os.makedirs(flat)
    with open(os.path.join(flat, "BRK.B_processed_data.csv"), "w") as f:
        f.write("Date,Open,High,Low,Close,Volume,Dividends,Stock Splits,MA_20\n2024-01-02,1,3,0.5,2.5,100,0.0,0.0,2.25\n")
        f.write("2024-01-03 00:00:00-05:00,1,3,0.5,0.0005,100,0.0,0.0,\n")
    rows = IO.read_prices_csv(spark, flat, layout="files").orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.low, r.close, r.ma_20) for r in rows] == [("BRK.B", "2024-01-02", 0.5, 2.5, 2.25), ("BRK.B", "2024-01-03", 0.5, 0.0005, None)]


def test_union_survives_a_missing_source(spark):
    from pricelab.operators.news import union_headlines
    from pricelab.streaming.jobs import HEADLINE_STREAM_SCHEMA

    present = scratch_path(spark, "news-a")
    spark.createDataFrame([("T", None, None, "hello", "a", "en", 1)], HEADLINE_STREAM_SCHEMA).write.parquet(present)
    a = IO.read_optional(spark, present, HEADLINE_STREAM_SCHEMA)
    b = IO.read_optional(spark, scratch_path(spark, "news-missing"), HEADLINE_STREAM_SCHEMA)
    assert b.count() == 0
    assert [r.title for r in union_headlines(a, b).collect()] == ["hello"]
