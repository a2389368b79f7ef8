"""Structured Streaming jobs (file sources, ``availableNow`` triggers, checkpoints).

All three converge to the batch result under late, repeated and out-of-order
deliveries, and replaying a micro-batch changes nothing:

* ``incremental_corpus``: raw daily bars arrive in files of any cut. The state
  of a ticker is its series (one bar a day, the last delivered). A micro-batch
  compares the ingested series before and after and writes only the prompts
  whose windows reach the first row that changed: one new day at the end gives the few
  positions that fit from now on, a late or corrected bar all from there. What an
  earlier batch wrote of those is retracted by one narrow row.
* ``headline_dedupe``: two headline streams; a micro-batch adds the titles that
  the output does not hold yet, however late they come. Bloom filters, one for
  each (month, bucket) partition of the output, say which partitions can hold
  a title; only those are read for the exact comparison.
* ``rolling_summary``: per-ticker ordered fold over arriving chunks. The state
  keeps a series' chunks with the summary after each (bounded by the length of
  the series); a late chunk takes its place and the fold goes on from there.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import constants as K
from ..operators.corpus import choose_window, fitting, prefix_series, render_prompts

BAR_STREAM_SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"
HEADLINE_STREAM_SCHEMA = ("ticker string, date date, published_at timestamp_ntz, title string, source string, "
                          "lang string, relevancy long")
CHUNK_STREAM_SCHEMA = "ticker string, chunk_no int, chunk_text string"

# ---------------------------------------------------------------------------
# incremental corpus
# ---------------------------------------------------------------------------

#: A ticker's bars by day: days since 1970 (int32), closes (float64), which bars have all values (uint8).
BAR_STATE = "days binary, closes binary, whole binary"
#: ``changed``: first row that is not as before; ``base``: row of the first close that is handed on; ``rows``: how many
#: the series has now, and had before.
CHANGES = "ticker string, changed int, base int, rows int, rows_before int, closes array<double>"
PROMPT_SCHEMA = "i int, pred_days int, context_days int, text string, ticker string, batch long"
RETRACTED_SCHEMA = "ticker string, changed int, batch long"


def ingested(days: np.ndarray, closes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(day, close) of the rows that ``features.ingest`` keeps: all values there, and ``MA_WINDOW`` closes up to them."""
    there = np.cumsum(np.r_[0, ~np.isnan(closes)])
    at = np.arange(len(days))
    full = there[at + 1] - there[np.maximum(at + 1 - K.MA_WINDOW, 0)] == K.MA_WINDOW
    keep = whole.astype(bool) & full
    return days[keep], closes[keep]


def _series_change(reach_back: int, reach_ahead: int) -> Callable:
    values = ["open", "high", "low", "close", "volume"]

    def fn(key, pdfs, state) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (b"", b"", b"")
        days, closes, whole = (np.frombuffer(b, t) for b, t in zip(old, ("<i4", "<f8", "u1")))
        before = ingested(days, closes, whole)
        rows = pd.concat(list(pdfs), ignore_index=True)
        rows = rows[rows["date"].notna()].sort_values(values, na_position="first", kind="stable").drop_duplicates("date", keep="last")
        day = pd.to_datetime(rows["date"]).to_numpy().astype("datetime64[D]").astype("<i4")
        rest = ~np.isin(days, day)
        days, order = np.unique(np.concatenate([days[rest], day]), return_index=True)
        closes = np.concatenate([closes[rest], rows["close"].to_numpy(np.float64)])[order]
        whole = np.concatenate([whole[rest], rows[values].notna().all(axis=1).to_numpy().astype("u1")])[order]
        state.update((days.astype("<i4").tobytes(), closes.astype("<f8").tobytes(), whole.astype("u1").tobytes()))
        now = ingested(days, closes, whole)
        n = min(len(before[0]), len(now[0]))
        same = (before[0][:n] == now[0][:n]) & (before[1][:n] == now[1][:n])
        changed = n if same.all() else int(np.argmin(same))
        if changed < max(len(before[0]), len(now[0])):
            base = max(0, changed - reach_ahead - reach_back)
            yield pd.DataFrame({"ticker": [key[0]], "changed": [changed], "base": [base], "rows": [len(now[0])],
                                "rows_before": [len(before[0])], "closes": [now[1][base:].tolist()]})

    return fn


def changed_prompts(changes: DataFrame, seed: int = 42, horizons=K.CORPUS_HORIZONS, template: str = K.TRAINING_PROMPT) -> DataFrame:
    """The prompts of ``changes`` (rows of ``CHANGES``) whose windows reach the first changed row."""
    bars = changes.select("ticker", F.posexplode("closes").alias("date", "close"))  # the row number orders as the date does
    rows = prefix_series(bars).join(changes.select("ticker", "changed", "base", F.col("rows").alias("n")), "ticker")
    first = F.greatest(F.col("changed") - max(p for p, _ in horizons) + 1, F.lit(0))
    rows = rows.where(first < F.col("n")).withColumn("i", F.explode(F.sequence(first, F.col("n") - 1)))
    rows = fitting(choose_window(rows, seed, horizons)).where(F.col("i") + F.col("pred_days") > F.col("changed"))
    return render_prompts(rows.withColumn("at", F.col("i") - F.col("base")), template)


def incremental_corpus(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str, seed: int = 42,
                       max_files_per_trigger: int | None = None) -> None:
    """Run the corpus stream until the available files are processed (``availableNow``).

    Each ticker's whole history counts (a trailing period would move with every
    delivery). ``output_dir`` gets ``prompts/batch=N`` and ``retracted/batch=N``;
    a replayed batch overwrites its own folders. Read with ``corpus_view``.
    """
    reader = spark.readStream.schema(BAR_STREAM_SCHEMA).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    back, ahead = (max(h[k] for h in K.CORPUS_HORIZONS) for k in (1, 0))
    changes = reader.parquet(input_dir).groupBy("ticker").applyInPandasWithState(
        _series_change(back, ahead), CHANGES, BAR_STATE, "append", GroupStateTimeout.NoTimeout)

    def batch(df: DataFrame, epoch_id: int) -> None:
        df = df.persist()  # the state is read once for both outputs
        try:
            for name, rows in (("prompts", changed_prompts(df, seed)), ("retracted", df.where("changed < rows_before").select("ticker", "changed"))):
                rows.write.mode("overwrite").parquet(os.path.join(output_dir, name, f"batch={epoch_id}"))
        finally:
            df.unpersist()

    q = (changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def corpus_view(spark: SparkSession, output_dir: str) -> DataFrame:
    """The corpus as it stands: of each (ticker, i) the last batch's prompt, unless a later batch retracted it.

    Retractions are narrow and few (late bars); of a ticker those that can kill a row are its later ones, so one sorted
    pass over both finds, for each prompt, the earliest changed row of all later batches.
    """
    prompts = spark.read.schema(PROMPT_SCHEMA).parquet(os.path.join(output_dir, "prompts"))
    gone = spark.read.schema(RETRACTED_SCHEMA).parquet(os.path.join(output_dir, "retracted"))
    gone = gone.withColumn("before", F.min("changed").over(Window.partitionBy("ticker").orderBy(F.col("batch").desc())))
    gone = gone.groupBy(F.col("ticker").alias("t")).agg(F.array_sort(F.collect_list(F.struct("batch", "before"))).alias("later"))
    rows = prompts.join(gone, F.col("ticker") == F.col("t"), "left")
    # the first retraction behind the prompt's batch carries the smallest row changed by any from there on
    first = F.try_element_at(F.filter("later", lambda x: x["batch"] > F.col("batch")), F.lit(1))["before"]
    return rows.where(first.isNull() | (F.col("i") + F.col("pred_days") <= first)).select(*prompts.columns)


def compact_corpus(spark: SparkSession, output_dir: str, target_dir: str, batch: int) -> None:
    """Write the view as one batch (``batch``: a number below the next one) of a new folder, which a run can go on with."""
    corpus_view(spark, output_dir).drop("batch").write.parquet(os.path.join(target_dir, "prompts", f"batch={batch}"))
    spark.createDataFrame([], "ticker string, changed int").write.parquet(os.path.join(target_dir, "retracted", f"batch={batch}"))


# ---------------------------------------------------------------------------
# headline de-duplication
# ---------------------------------------------------------------------------

BUCKETS = 64  # title buckets of a month
FILTER_BITS, PROBES = 1 << 20, 5  # of one partition's Bloom filter; about 100,000 titles at 10 bits each
TITLE_SCHEMA = HEADLINE_STREAM_SCHEMA + ", month string, bucket int"
FILTER_SCHEMA = "month string, word int, bits long, bucket int"


def _bits(rows: DataFrame, bits: int) -> DataFrame:
    """Each row once for every bit of its title: (word, bit)."""
    at = [F.pmod(F.xxhash64(F.lit(k), "ticker", "title"), F.lit(bits)) for k in range(PROBES)]
    rows = rows.withColumn("_at", F.explode(F.array_distinct(F.array(*at))))
    return rows.withColumn("word", F.expr("int(_at div 64)")).withColumn("bit", F.expr("shiftleft(1L, int(_at % 64))")).drop("_at")


def titles_with_home(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds the partition that a title goes to: the month of its publication, and a bucket of (ticker, title)."""
    month = F.coalesce(F.date_format("published_at", "yyyy-MM"), F.lit("none"))
    return rows.withColumn("month", month).withColumn("bucket", F.pmod(F.xxhash64("ticker", "title"), F.lit(buckets)).cast("int"))


def possible_homes(new: DataFrame, filters: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(ticker, title, bucket, home) of every partition of a title's bucket whose filter has all its bits.

    A join on (bucket, word): filter words are spread over the bits of all titles, so no month or bucket is one
    task's. Words of several batches are joined by OR first.
    """
    words = filters.groupBy("bucket", F.col("month").alias("home"), "word").agg(F.bit_or("bits").alias("bits"))
    asked = _bits(new.select("ticker", "title", "bucket", F.xxhash64("ticker", "title").alias("key")), bits)
    total = asked.groupBy("bucket", "key", "ticker", "title").agg(F.count("*").alias("asked"))
    hit = asked.join(words, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    hit = hit.groupBy("bucket", "key", "ticker", "title", "home").agg(F.count("*").alias("n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("ticker", "title")]
    both = total.alias("a").join(hit.alias("b"), [F.col("a.key") == F.col("b.key"), *same])
    return both.where("n = asked").select("a.ticker", "a.title", "a.bucket", "home")


def partitions_with(store: DataFrame, homes: DataFrame) -> DataFrame:
    """The partitions of ``store`` named by ``homes``, as a filter on its partition columns.

    One row for each partition comes to the driver: numbers of months and buckets, not titles.
    """
    found = homes.groupBy("home").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")).collect()
    here = F.lit(False)
    for r in found:
        here = here | ((F.col("month") == r["home"]) & F.col("bucket").isin(r["buckets"]))
    return store.where(here)


def headline_dedupe(spark: SparkSession, input_dirs: list[str], output_dir: str, checkpoint_dir: str,
                    buckets: int = BUCKETS, filter_bits: int = FILTER_BITS) -> None:
    """Run the stream until the available files are processed.

    ``output_dir`` gets the titles (``titles/month=/bucket=``) and their filters (``filters/bucket=``). The row kept is
    that of the first delivery, and within it of the earliest publication. Filters are written first: a batch that
    ended between the two is run again, and the exact comparison finds what is there and what is not.
    """
    streams = [spark.readStream.schema(HEADLINE_STREAM_SCHEMA).option("recursiveFileLookup", "true").parquet(d)
               for d in input_dirs]
    u = streams[0]
    for s in streams[1:]:
        u = u.unionByName(s)
    titles_dir, filters_dir = (os.path.join(output_dir, x) for x in ("titles", "filters"))

    def batch(df: DataFrame, epoch_id: int) -> None:
        rest = [c for c in df.columns if c not in ("ticker", "title", "published_at")]
        new = df.groupBy("ticker", "title").agg(F.min(F.struct("published_at", *rest)).alias("_m")).select("ticker", "title", "_m.*")
        new = titles_with_home(new, buckets).persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            fresh = new
            filters = optional(spark, filters_dir, FILTER_SCHEMA).where(F.col("bucket").isin(touched))
            titles = optional(spark, titles_dir, TITLE_SCHEMA)
            homes = possible_homes(new, filters, filter_bits).persist()
            there = partitions_with(titles, homes).select(F.col("ticker").alias("_t"), F.col("title").alias("_h"), F.col("bucket").alias("_b"))
            homes.unpersist()
            same = (F.col("bucket") == F.col("_b")) & F.col("ticker").eqNullSafe(F.col("_t")) & F.col("title").eqNullSafe(F.col("_h"))
            fresh = new.join(there, same, "left_anti").persist()
            words = _bits(fresh, filter_bits).groupBy("month", "bucket", "word").agg(F.bit_or("bit").alias("bits"))
            words.select(*[c.split()[0] for c in FILTER_SCHEMA.split(", ")]).write.mode("append").partitionBy("bucket").parquet(filters_dir)
            fresh.select(*[c.split()[0] for c in TITLE_SCHEMA.split(", ")]).write.mode("append").partitionBy("month", "bucket").parquet(titles_dir)
            fresh.unpersist()
        finally:
            new.unpersist()

    q = (u.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table, or an empty one before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def distinct_titles(spark: SparkSession, output_dir: str) -> DataFrame:
    return optional(spark, os.path.join(output_dir, "titles"), TITLE_SCHEMA)


# ---------------------------------------------------------------------------
# rolling summary
# ---------------------------------------------------------------------------

SUMMARY_STATE = "chunks string"  # JSON: [[number, text, summary after it], ...] in order
SUMMARY_OUT = "ticker string, summary string, n_chunks int"


def _summary_fold(factory: Callable):
    from ..operators.models import cached_model, model_id

    name = model_id(factory)

    def fn(key, pdfs, state):
        model = cached_model(name, factory)
        chunks = json.loads(state.get[0]) if state.exists else []
        known = {c[0] for c in chunks}
        rows = pd.concat(list(pdfs), ignore_index=True).drop_duplicates("chunk_no")
        new = [[int(n), t, None] for n, t in zip(rows["chunk_no"], rows["chunk_text"]) if int(n) not in known]
        if not new:
            return
        first = min(c[0] for c in new)
        chunks = sorted(chunks + new, key=lambda c: c[0])
        at = next(k for k, c in enumerate(chunks) if c[0] == first)
        summary = chunks[at - 1][2] if at else K.INITIAL_SUMMARY
        for c in chunks[at:]:  # a late chunk: the fold goes on from its place
            out = (model([K.SUMMARIZER_PROMPT.format(prior=summary, chunk=c[1])])[0] or "").strip()
            summary = c[2] = out or summary
        state.update((json.dumps(chunks),))
        yield pd.DataFrame({"ticker": [key[0]], "summary": [summary], "n_chunks": [len(chunks)]})

    return fn


def rolling_summary(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                    factory: Callable) -> None:
    src = spark.readStream.schema(CHUNK_STREAM_SCHEMA).option("recursiveFileLookup", "true").parquet(input_dir)
    out = src.groupBy("ticker").applyInPandasWithState(
        _summary_fold(factory), SUMMARY_OUT, SUMMARY_STATE, "append", GroupStateTimeout.NoTimeout)
    q = (out.writeStream.format("parquet").option("path", output_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def latest_summaries(spark: SparkSession, output_dir: str) -> DataFrame:
    """Final summary per ticker: the emitted row with the most chunks."""
    df = spark.read.parquet(output_dir)
    return df.groupBy("ticker").agg(F.max_by("summary", "n_chunks").alias("summary"))
