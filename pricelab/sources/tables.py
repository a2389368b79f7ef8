"""Readers for the given Parquet tables and the derived test tables.

The derived tables (bars, headlines, requests) are plain DataFrame plans over
the driver's tables, so their work grows with the input:

* ``bars``: one OHLCV bar per (ticker, day) from ``lineitem`` x ``part``.
  The join is left to Catalyst: ``part`` is broadcast only when its size
  estimate is under ``spark.sql.autoBroadcastJoinThreshold`` (checked by the
  planner, re-checked at runtime by AQE); otherwise sort-merge with AQE skew
  splitting. The aggregate runs partial (map-side) before its shuffle, so a
  hot ticker is pre-aggregated per task.
* ``headlines``: union of titles from ``pages`` and ``documents``.
* ``requests``: one forecast request per ticker plus one unknown ticker.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES -- fixture constants (see FIXTURES.md)
LAST_SHIP_DATE = "2001-11-04"
N_TICKERS_MOD = 25
HEADLINE_DAYS = 60
QUOTE_URL = "https://quotes.example.com/quote/"
UNKNOWN_TICKER = "NOSUCH"
SECOND_REQUEST = 1017  # added to the number (and so to the horizon) of a ticker's second request
BAD_URL_REQUEST, BAD_URL = 5000, "https://quotes.example.com/quote/BAD TICKER|x"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def files_state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Number, bytes and a hash of path, time and length of the tables' files: another value once a file changes.

    Only the files' names and status are read, in tasks; their content is not.
    """
    files = spark.read.format("binaryFile").load([os.path.join(sf_dir, f"{n}.parquet") for n in names])
    return tuple(files.select("path", "modificationTime", "length").agg(
        F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first())


def order_key():
    """(l_orderkey, l_linenumber, l_partkey, l_suppkey) in one decimal: 13, 2, 12 and 11 digits.

    A number of fixed width is a key that a hash aggregate can hold; a struct
    would have every raw row sorted before and after the shuffle.
    """
    out = F.col("l_orderkey").cast("decimal(38,0)")
    for c, digits in (("l_linenumber", 2), ("l_partkey", 12), ("l_suppkey", 11)):
        out = (out * F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast("decimal(38,0)") + F.col(c).cast("decimal(12,0)")
    return out.cast("decimal(38,0)")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bars(ticker, date, open, high, low, close, volume)``."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
               "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.concat(F.lit("B"), F.substr("p_brand", F.lit(7))).alias("ticker"),
                    F.to_date("l_shipdate").alias("date"),
                    order_key().alias("key"), "l_extendedprice", "l_quantity")
            .groupBy("ticker", "date")
            .agg(F.min_by("l_extendedprice", "key").alias("open"),
                 F.max("l_extendedprice").alias("high"),
                 F.min("l_extendedprice").alias("low"),
                 F.max_by("l_extendedprice", "key").alias("close"),
                 F.sum("l_quantity").alias("volume")))


def _published_at(date_col, rel_col):
    # a deterministic time of day so that ordering by publication time is total;
    # TIMESTAMP_NTZ (wall clock), so text renderings do not depend on the session time zone
    secs = ((rel_col * 7919) % 86400).cast("int")
    return date_col.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``headlines(ticker, date, published_at, title, source, lang, relevancy)``."""
    last = F.to_date(F.lit(LAST_SHIP_DATE))
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    a = pages.select(
        F.concat(F.lit("B"), (F.col("page_id") % N_TICKERS_MOD + 1).cast("string")).alias("ticker"),
        F.date_sub(last, (F.col("page_id") % HEADLINE_DAYS).cast("int")).alias("date"),
        F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"),
        F.lit("pages").alias("source"),
        F.lit("en").alias("lang"),
        F.col("page_id").alias("relevancy"))
    b = docs.select(
        F.concat(F.lit("B"), (F.col("doc_id") % N_TICKERS_MOD + 1).cast("string")).alias("ticker"),
        F.date_sub(last, (F.floor(F.col("doc_id") / N_TICKERS_MOD) % HEADLINE_DAYS).cast("int")).alias("date"),
        F.trim(F.substring_index("text", "\n", 1)).alias("title"),
        F.lit("documents").alias("source"),
        F.col("lang"),
        F.col("doc_id").alias("relevancy"))
    u = a.unionByName(b)
    return u.select("ticker", "date", _published_at(F.col("date"), F.col("relevancy")).alias("published_at"),
                    "title", "source", "lang", "relevancy")


def requests(spark: SparkSession, sf_dir: str, bars_df: DataFrame | None = None) -> DataFrame:
    """``requests(request_id, url, prediction_days)``: two horizons per ticker, one unknown ticker, one bad URL."""
    b = bars_df if bars_df is not None else bars(spark, sf_dir)
    rid = F.substr("ticker", F.lit(2)).cast("bigint")
    t = b.select("ticker").distinct().select("ticker", rid.alias("request_id"))
    suffix = (F.when(F.col("request_id") % 3 == 0, F.lit(""))
              .when(F.col("request_id") % 3 == 1, F.lit("/"))
              .otherwise(F.lit("?p=x")))
    known = t.select("request_id", F.concat(F.lit(QUOTE_URL), "ticker", suffix).alias("url"),
                     F.explode(F.array(F.lit(0), F.lit(SECOND_REQUEST))).alias("more"))
    known = known.select((F.col("request_id") + F.col("more")).cast("bigint").alias("request_id"), "url",
                         (F.lit(1) + (F.col("request_id") * 13 + F.col("more")) % 95).cast("int").alias("prediction_days"))
    unknown = spark.range(1).select(F.lit(0).cast("bigint").alias("request_id"),
                                    F.lit(QUOTE_URL + UNKNOWN_TICKER).alias("url"),
                                    F.lit(5).alias("prediction_days"))
    bad = unknown.select(F.lit(BAD_URL_REQUEST).cast("bigint").alias("request_id"), F.lit(BAD_URL).alias("url"), "prediction_days")
    return known.unionByName(unknown).unionByName(bad)


# FIXED VALUES -- stand-in model answers of the responses fixture
RESPONSE_PROSE_HEAD = "Sure. Here is my forecast: "
RESPONSE_PROSE_TAIL = " -- hope this helps."
RESPONSE_NO_NUMBER = "I cannot forecast this stock."


def responses(spark: SparkSession, sf_dir: str, requests_df: DataFrame | None = None,
              series: DataFrame | None = None) -> DataFrame:
    """``responses(request_id, text)``: stand-in model output per answerable request.

    ``PREDICTION: [p1, ..]`` with ``p_k = last * (1 + 0.01 * ((7k mod 5) - 2))``;
    by ``request_id % 5``: exact length, 3 too many, half, prose around the
    numbers, no number at all.
    """
    from ..functions.scalar import ticker_from_url
    from ..functions.text import fmt2_strict
    from ..operators.features import ingest, series_arrays

    r = requests_df if requests_df is not None else requests(spark, sf_dir)
    s = series if series is not None else series_arrays(ingest(bars(spark, sf_dir)))
    j = r.withColumn("ticker", ticker_from_url("url")).join(s, "ticker", "inner")
    n = F.col("prediction_days")
    mode = F.col("request_id") % 5
    k = (F.when(mode == 1, n + 3).when(mode == 2, F.greatest(F.floor(n / 2).cast("int"), F.lit(1)))
         .when(mode == 4, F.lit(0)).otherwise(n))
    last = F.try_element_at("closes", F.lit(-1))
    prices = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
                         lambda x: fmt2_strict(last * (F.lit(1.0) + F.lit(0.01) * (((x * 7) % 5) - 2))))
    body = F.concat(F.lit(" ["), F.array_join(prices, ", "), F.lit("]"))
    text = (F.when(mode == 4, F.lit(" " + RESPONSE_NO_NUMBER))
            .when(mode == 3, F.concat(F.lit(" " + RESPONSE_PROSE_HEAD), body, F.lit(RESPONSE_PROSE_TAIL)))
            .otherwise(body))
    return j.select("request_id", F.concat(F.lit("PREDICTION:"), text).alias("text"))
