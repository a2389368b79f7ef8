"""File readers and writers: price CSVs, ticker JSON, portfolio JSON, prompt JSONL, records.

Writers go to shared storage (a path the caller owns; tests use a folder below
``spark.checkpoint.dir``). Readers use explicit schemas -- no inference pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICE_SCHEMA = ("date date, open double, high double, low double, close double, volume double, "
                "ma_20 double")
CORPUS_SCHEMA = "ticker string, i long, pred_days long, context_days long, text string, _corrupt_record string"


# ---------------------------------------------------------------------------
# prices
# ---------------------------------------------------------------------------

def write_prices(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One folder per ticker (``ticker=<T>/``), header row, no index.

    ``repartition('ticker')`` puts each ticker's bars in one task, so each
    ticker folder gets one file; a ticker holds at most one bar per day.
    """
    w = df.repartition("ticker").write.mode(mode).partitionBy("ticker")
    if fmt == "csv":
        w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        w.format(fmt).save(path)


def read_prices_csv(spark: SparkSession, path: str, layout: str = "partitioned", keep_corrupt: bool = False) -> DataFrame:
    """Read price CSVs by their header's names, in any order and case; further columns are left out.

    ``layout='partitioned'``: folders written by ``write_prices``.
    ``layout='files'``: flat ``<TICKER>_processed_data.csv`` files; the ticker
    comes from the file name. A row with a value that is no number or date is
    left out, whatever columns are asked for; ``keep_corrupt=True`` keeps it, with
    its text in ``corrupt_record`` (NULL for good rows).
    """
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False)
    df = r.option("basePath", path).csv(path) if layout == "partitioned" else r.csv(path)
    there = {c.strip().lower(): c for c in df.columns}
    if layout == "partitioned":
        ticker = F.col("ticker").cast("string")
    else:
        ticker = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_processed_data", 1)
    cols, bad = [], F.lit(False)
    for name, kind in (f.split() for f in PRICE_SCHEMA.split(", ")):
        if name not in there:
            cols.append(F.lit(None).cast(kind).alias(name))
            continue
        raw = F.nullif(F.trim(F.col(f"`{there[name]}`")), F.lit(""))
        value = (F.substr(raw, F.lit(1), F.lit(10)) if kind == "date" else raw).try_cast(kind)
        bad = bad | (raw.isNotNull() & value.isNull())
        cols.append(value.alias(name))
    text = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns if c != "ticker" or layout == "files"])
    out = df.select(ticker.alias("ticker"), *cols, F.when(bad, text).alias("corrupt_record"))
    return out if keep_corrupt else out.where(F.col("corrupt_record").isNull()).drop("corrupt_record")


# ---------------------------------------------------------------------------
# ticker universe / portfolio (small JSON documents)
# ---------------------------------------------------------------------------

def universe_json(df: DataFrame, col: str = "ticker") -> DataFrame:
    """One row: ``{"tickers": [...]}`` sorted unique -- the document is the universe itself."""
    return df.agg(F.sort_array(F.collect_set(col)).alias("tickers")).select(
        F.to_json(F.struct("tickers")).alias("value"))


def write_universe(df: DataFrame, path: str, col: str = "ticker") -> bool:
    """Overwrite the universe JSON; an empty universe aborts without touching the file."""
    if df.select(col).where(F.col(col).isNotNull()).isEmpty():
        return False
    universe_json(df.where(F.col(col).isNotNull()), col).coalesce(1).write.mode("overwrite").text(path)
    return True


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, ticker)`` in file order; a missing or invalid file gives no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
        parsed = raw.select(F.from_json("value", "struct<tickers:array<string>>").alias("j"))
        return parsed.select(F.posexplode(F.coalesce(F.col("j.tickers"), F.array().cast("array<string>")))
                             .alias("pos", "ticker")).select(F.col("pos").cast("bigint"), "ticker")
    except Exception:  # noqa: BLE001 -- missing path: empty universe, as the application does
        return spark.createDataFrame([], "pos bigint, ticker string")


def write_portfolio(portfolio: DataFrame, path: str) -> None:
    """JSON array of tickers in ``pos`` order (at most 15 entries)."""
    doc = portfolio.agg(F.array_sort(F.collect_list(F.struct("pos", "ticker"))).alias("p")).select(
        F.to_json(F.col("p.ticker")).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def read_portfolio(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "ticker")).select(
        F.col("pos").cast("bigint"), "ticker")


# ---------------------------------------------------------------------------
# prompt corpus (JSON lines)
# ---------------------------------------------------------------------------

def write_corpus(corpus: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines partitioned by ticker (keeps the ticker for resume checks)."""
    corpus.write.mode(mode).partitionBy("ticker").json(path)


def read_corpus(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """Read ``{"text": ...}`` lines.

    tolerant: corrupted lines and lines without ``text`` are skipped.
    strict: a corrupted line fails the read (FAILFAST) and a line without
    ``text`` raises at evaluation time.
    """
    r = spark.read.schema(CORPUS_SCHEMA)
    if tolerant:
        df = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
        return df.where(F.col("_corrupt_record").isNull() & F.col("text").isNotNull()).drop("_corrupt_record")
    df = r.option("mode", "FAILFAST").json(path).drop("_corrupt_record")
    return df.withColumn("text", F.when(F.col("text").isNull(), F.raise_error(F.lit("corpus line without text")))
                         .otherwise(F.col("text")))


# ---------------------------------------------------------------------------
# result records and link extraction
# ---------------------------------------------------------------------------

def to_records(df: DataFrame, key: str = "request_id") -> DataFrame:
    """One JSON document per result row (all fields kept, NULLs omitted)."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns])).alias("record"))


PRICE_ROW = ("date", "open", "high", "low", "close", "volume")


def with_prices(results: DataFrame, prices: DataFrame, asof: str = "asof", out: str = "historical_data") -> DataFrame:
    """Each result with the bars of its ticker up to its ``asof`` date, by day, as a list of records.

    The lists (bounded by the calendar) are made once for each (ticker, asof) that occurs and joined to the
    results as they are written; a result without an ``asof`` date, as a failed one, has an empty list.
    """
    asked = results.select("ticker", F.col(asof).alias("_asof")).where("_asof is not null").distinct()
    bars = asked.join(prices.select("ticker", *PRICE_ROW), "ticker").where(F.col("date") <= F.col("_asof"))
    lists = bars.groupBy("ticker", "_asof").agg(F.array_sort(F.collect_list(F.struct(*PRICE_ROW))).alias(out))
    both = results.alias("r").join(lists.alias("p"), [F.col("r.ticker") == F.col("p.ticker"), F.col(f"r.{asof}") == F.col("p._asof")], "left")
    return both.select("r.*", F.coalesce(out, F.array().cast(lists.schema[out].dataType)).alias(out))


def write_records(df: DataFrame, path: str, key: str = "request_id") -> None:
    to_records(df, key).select("record").write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records as columns of ``schema`` (that of the results that were written)."""
    return spark.read.schema(schema).json(path)


def extract_link_texts(pages: DataFrame, pattern: str = r"<li><a[^>]*>([^<]*)</a>") -> DataFrame:
    """Link texts of list items: trimmed, non-empty, unique (``symbol``)."""
    t = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("s"))
    return t.select(F.trim("s").alias("symbol")).where(F.col("symbol") != "").distinct()


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A source that may be missing: an empty DataFrame of ``schema`` instead of an error.

    Lets a union of several headline sources survive one source being absent
    (the application logs the failing source and keeps the others).
    """
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
