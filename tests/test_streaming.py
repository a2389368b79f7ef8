import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelab.operators import corpus as CO
from pricelab.plans import standins as SI
from pricelab.session import scratch_path
from pricelab.streaming import jobs as S

from .conftest import bars_df


def stream_equals_batch(spark, out, bars):
    from pricelab.operators.features import ingest

    view = S.corpus_view(spark, out)
    stream = {(r.ticker, r.i, r.pred_days, r.text) for r in view.collect()}
    batch = {(r.ticker, r.i, r.pred_days, r.text) for r in CO.ts_corpus(ingest(bars, None)).collect()}
    assert stream == batch and view.count() == len(batch)


def test_incremental_corpus_monthly_late_and_duplicate_files(spark):
    closes = [100.0 + (k % 11) for k in range(260)]
    bars = bars_df(spark, {"A": closes, "B": closes[:200], "C": closes[:120]})
    base = scratch_path(spark, "t-stream")
    inp, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    month = F.date_format("date", "yyyy-MM")
    months = sorted(r[0] for r in bars.select(month).distinct().collect())
    for m in months[:-1]:  # one file per month, several micro-batches
        bars.where(month == m).coalesce(1).write.parquet(os.path.join(inp, "m" + m))
    S.incremental_corpus(spark, inp, out, ck, max_files_per_trigger=2)
    bars.where(month == months[-1]).coalesce(1).write.parquet(os.path.join(inp, "late"))  # late month
    bars.where(month == months[0]).coalesce(1).write.parquet(os.path.join(inp, "again"))  # delivered twice
    S.incremental_corpus(spark, inp, out, ck, max_files_per_trigger=2)
    S.incremental_corpus(spark, inp, out, ck)  # nothing new
    stream_equals_batch(spark, out, bars)
    S.compact_corpus(spark, out, out + "-one", 99)
    stream_equals_batch(spark, out + "-one", bars)


def test_incremental_corpus_writes_what_changed(spark):
    closes = [50.0 + (k * 7 % 13) for k in range(200)]
    whole = bars_df(spark, {"A": closes, "B": closes})
    day = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    whole = whole.withColumn("n", day).persist()
    base = scratch_path(spark, "t-change")
    inp, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))

    def deliver(name, rows):
        rows.select(*[c.split()[0] for c in S.BAR_STREAM_SCHEMA.split(", ")]).coalesce(1).write.parquet(os.path.join(inp, name))
        S.incremental_corpus(spark, inp, out, ck)

    def written(batch):
        return spark.read.schema(S.PROMPT_SCHEMA).parquet(os.path.join(out, "prompts")).where(F.col("batch") == batch)

    missing = (F.col("ticker") == "A") & (F.col("n") == 150)
    deliver("d1", whole.where((F.col("n") <= 199) & ~missing))
    assert written(0).count() > 50
    deliver("d2", whole.where((F.col("n") == 200) & (F.col("ticker") == "B")))  # one new day of one ticker
    new = written(1).collect()
    rows = 200 - 19  # without those that have no average yet
    assert 0 < len(new) < 10 and {(r.ticker, r.i + r.pred_days) for r in new} == {("B", rows)}
    assert spark.read.schema(S.RETRACTED_SCHEMA).parquet(os.path.join(out, "retracted")).count() == 0
    deliver("d3", whole.where(missing | ((F.col("n") == 200) & (F.col("ticker") == "A"))))  # a late bar
    assert {r.ticker for r in written(2).collect()} == {"A"} and written(2).agg(F.min(F.col("i") + F.col("pred_days"))).first()[0] > 150 - 20
    stream_equals_batch(spark, out, whole.drop("n"))
    fixed = whole.withColumn("close", F.when((F.col("ticker") == "B") & (F.col("n") == 120), 99.5).when((F.col("ticker") == "A") & (F.col("n") == 190), None).otherwise(F.col("close")))
    deliver("d4", fixed.where("(ticker = 'B' and n = 120) or (ticker = 'A' and n = 190)"))  # corrections, one to no value
    stream_equals_batch(spark, out, fixed.drop("n"))
    deliver("d5", fixed.where("n between 10 and 20"))  # days delivered again change nothing
    assert written(4).count() == 0
    stream_equals_batch(spark, out, fixed.drop("n"))


def test_rolling_summary_takes_late_chunks_in_order(spark):
    base = scratch_path(spark, "t-sum")
    inp, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    text = ", ".join("1.00" for _ in range(40))
    spark.createDataFrame([("T", 0, text), ("T", 2, text)], S.CHUNK_STREAM_SCHEMA).write.parquet(os.path.join(inp, "a"))
    S.rolling_summary(spark, inp, out, ck, SI.chunk_summarizer)
    spark.createDataFrame([("T", 1, text), ("T", 3, text)], S.CHUNK_STREAM_SCHEMA).write.parquet(os.path.join(inp, "b"))
    S.rolling_summary(spark, inp, out, ck, SI.chunk_summarizer)
    r = S.latest_summaries(spark, out).first()
    assert r.summary.startswith("Chunk 4,")  # chunk 1 arrived late and took its place


def test_headlines_neither_twice_nor_lost(spark):
    import datetime as dt

    base = scratch_path(spark, "t-news")
    inp, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    day = lambda n: dt.datetime(2024, 3, 1) + dt.timedelta(days=n)
    for n, rows in enumerate(([("seen", 0)], [("other", 31)], [("seen", 31)], [("late", 3)], [("late", 40), ("seen", 0)])):
        df = spark.createDataFrame([("T", day(d).date(), day(d), t, "a", "en", n) for t, d in rows], S.HEADLINE_STREAM_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(inp)
        S.headline_dedupe(spark, [inp], out, ck)
    assert sorted(r.title for r in S.distinct_titles(spark, out).collect()) == ["late", "other", "seen"]


def test_headline_batch_reads_a_small_part_of_the_store(spark):
    import datetime as dt

    base = scratch_path(spark, "t-bloom")
    inp, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    rows = [("T", dt.date(2020, 1, 1) + dt.timedelta(days=3 * k), dt.datetime(2020, 1, 1) + dt.timedelta(days=3 * k), f"title {k}", "a", "en", k) for k in range(400)]
    rows += [(None, None, None, None, "a", "en", 1), ("T", None, None, "undated", "a", "en", 1)]
    spark.createDataFrame(rows, S.HEADLINE_STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(inp)
    S.headline_dedupe(spark, [inp], out, ck, buckets=4)
    store = S.distinct_titles(spark, out)
    months, files = store.select("month").distinct().count(), len(store.inputFiles())
    assert months > 30 and files > 60
    day = dt.datetime(2023, 6, 1)
    batch = [("T", day.date(), day, t, "b", "en", k) for k, t in enumerate(["new 1", "new 2", "title 17", "title 333", "undated"])] + [(None, None, None, None, "b", "en", 1)]
    new = S.titles_with_home(spark.createDataFrame(batch, S.HEADLINE_STREAM_SCHEMA), 4)
    homes = S.possible_homes(new, S.optional(spark, os.path.join(out, "filters"), S.FILTER_SCHEMA))
    found = {(r.title, r.home) for r in homes.collect()}
    assert found >= {("title 17", "2020-02"), ("title 333", "2022-09"), ("undated", "none"), (None, "none")} and len(found) <= 6
    read = S.partitions_with(store, homes)
    assert len(read.inputFiles()) == files  # of the table
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert read.select("month", "bucket").distinct().count() <= 6
    spark.createDataFrame(batch, S.HEADLINE_STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(inp)
    S.headline_dedupe(spark, [inp], out, ck, buckets=4)
    assert S.distinct_titles(spark, out).count() == 404
    # a filter of a single word says maybe to everything; the exact comparison decides all the same
    S.headline_dedupe(spark, [inp], out + "2", ck + "2", buckets=2, filter_bits=64)
    assert S.distinct_titles(spark, out + "2").count() == 404


def test_headline_batch_that_ended_between_its_writes(spark):
    import datetime as dt
    import shutil

    base = scratch_path(spark, "t-replay")
    inp, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    day = dt.datetime(2024, 5, 1)
    spark.createDataFrame([("T", day.date(), day, t, "a", "en", 1) for t in "abc"], S.HEADLINE_STREAM_SCHEMA).write.parquet(inp)
    S.headline_dedupe(spark, [inp], out, ck)
    shutil.move(os.path.join(out, "titles"), os.path.join(base, "lost"))  # filters written, titles not
    S.headline_dedupe(spark, [inp], out, ck + "-again")
    assert sorted(r.title for r in S.distinct_titles(spark, out).collect()) == ["a", "b", "c"]
