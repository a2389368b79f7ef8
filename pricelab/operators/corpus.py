"""Sliding (context, target) corpus: window choice, slices, statistics, text.

Plan (one job, no driver collect):

1. ``series_arrays``: per ticker one ``array_sort(collect_list(struct(date, close)))``
   -- bounded by the calendar (one bar per day), so safe to hold in one row.
2. ``explode(sequence(0, n-1))`` positions; the horizon choice is a
   deterministic md5 bucket of (seed, ticker, i) looked up in a literal array
   (no join), and rows that cannot fit are filtered *before* slicing.
3. ``slice`` gives context/target; mean and sample std come from exact prefix
   sums of the closes in whole units of 1e-8 (``prefix_series``), shifted by the
   window's own first close, so no digits cancel.
4. The prompt is one ``concat`` of literals and formatted columns.

Sliding ``collect_list`` frames would cost O(n*w) per horizon for all seven
horizons although each row uses one; the slice plan costs O(n*w) once.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import trend2
from ..functions.text import context_tag, fmt2, fmt2_strict, render

UNITS = 1e8  # whole units of a price in the exact sums


def md5_bucket(*parts: Column, start: int = 1) -> Column:
    """32-bit unsigned integer from 8 hex digits of md5(parts joined by '|')."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substr(h, F.lit(start), F.lit(8)), 16, 10).cast("bigint")


def choose_window(df: DataFrame, seed: int = 42, horizons=K.CORPUS_HORIZONS,
                  key=("ticker", "i")) -> DataFrame:
    """Adds ``pred_days`` / ``context_days``: one horizon entry per row, uniform."""
    k = md5_bucket(F.lit(seed), *[F.col(c) for c in key]) % len(horizons) + 1
    preds = F.array(*[F.lit(p) for p, _ in horizons])
    ctxs = F.array(*[F.lit(c) for _, c in horizons])
    return (df.withColumn("_k", k.cast("int"))
            .withColumn("pred_days", F.element_at(preds, F.col("_k")))
            .withColumn("context_days", F.element_at(ctxs, F.col("_k")))
            .drop("_k"))


def array_moments(arr) -> tuple[Column, Column]:
    """(mean, sample std) of an array<double> in one ``aggregate`` pass.

    Sums are shifted by the first element ``k`` (``s = sum(x - k)``,
    ``ss = sum((x - k)^2)``), which keeps the one-pass variance stable for
    price levels far from zero. The expression is self-contained (no reference
    to another computed column), so when Catalyst inlines it -- e.g. while
    pushing a filter on the rendered text below the projection -- it costs a
    constant factor, never O(n^2). std is NULL for fewer than two values.
    """
    a = F.col(arr) if isinstance(arr, str) else arr
    # the shift k (first element) lives in the accumulator: the lambda never
    # references the outer array, so an array *expression* is evaluated once
    zero = F.struct(F.lit(None).cast("double").alias("k"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))

    def step(c, x):
        k = F.coalesce(c["k"], x)
        return F.struct(k.alias("k"), (c["s"] + (x - k)).alias("s"), (c["ss"] + (x - k) * (x - k)).alias("ss"))

    acc = F.aggregate(a, zero, step)
    n = F.size(a).cast("double")
    mean = F.when(F.size(a) > 0, acc["k"] + acc["s"] / n)
    var = F.when(F.size(a) > 1, (acc["ss"] - acc["s"] * acc["s"] / n) / (n - 1))
    # greatest() skips NULLs, so keep the NULL of a one-element list explicitly
    return mean, F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0))))


def array_mean(arr) -> Column:
    return array_moments(arr)[0]


def prefix_series(prices: DataFrame) -> DataFrame:
    """One row per ticker: closes, their 2-decimal texts, and exact prefix sums.

    With ``m_t`` the close in whole units of 1e-8, ``p1[j]`` and ``p2[j]`` are the
    DECIMAL sums of ``m_t`` and ``m_t ** 2`` over the first ``j`` closes
    (``p1[0] = p2[0] = 0``): running window sums, so the mean and sample std of any
    window come out of lookups instead of an O(c) fold, without rounding.
    """
    from .features import W

    run = W().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = prices.select("ticker", "date", "close", F.round(F.col("close") * UNITS).cast("decimal(19,0)").alias("_m"))
    v = v.select("ticker", "date", "close", "_m", F.sum("_m").over(run).cast("decimal(29,0)").alias("_p1"),
                 F.sum((F.col("_m") * F.col("_m")).cast("decimal(38,0)")).over(run).alias("_p2"))
    agg = v.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close", "_m", "_p1", "_p2"))).alias("_s"))
    return agg.select("ticker", F.col("_s.close").alias("closes"),
                      F.transform("_s.close", fmt2_strict).alias("close_texts"), F.col("_s._m").alias("units"),
                      F.concat(F.array(F.lit(0).cast("decimal(29,0)")), F.col("_s._p1")).alias("p1"),
                      F.concat(F.array(F.lit(0).cast("decimal(38,0)")), F.col("_s._p2")).alias("p2"))


def window_moments(start0: Column, length: Column) -> tuple[Column, Column]:
    """(mean, sample std) of ``length`` closes from 0-based ``start0``, from a row of ``prefix_series``.

    Sums of differences from the window's first close are exact integers until
    the last division, so a flat window has a std of 0 at any price.
    """
    a, b = start0 + 1, start0 + length + 1
    k = F.try_element_at("units", a)
    n = length.cast("decimal(10,0)")
    s1 = F.try_element_at("p1", b) - F.try_element_at("p1", a)
    s2 = F.try_element_at("p2", b) - F.try_element_at("p2", a)
    s = (s1 - n * k).cast("double")
    ss = (s2 - F.lit(2).cast("decimal(1,0)") * k * s1 + n * k * k).cast("double")
    m = length.cast("double")
    # the sum in exact decimals first: the mean of cents often is a tie of two decimals
    mean = (s1.cast("decimal(29,0)") * F.lit(Decimal("0.00000001"))).cast("double") / m
    var = F.when(length > 1, (ss - s * s / m) / (m - 1))
    return mean, F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0))) / UNITS)


def corpus_positions(prices: DataFrame, seed: int = 42, horizons=K.CORPUS_HORIZONS,
                     fixed: tuple[int, int] | None = None, every: bool = False) -> DataFrame:
    """``(ticker, closes, close_texts, units, p1, p2, n, i, pred_days, context_days)`` for every usable row.

    ``fixed=(context, pred)`` replaces the random choice (fixed-window variant); ``every=True`` gives each row all
    windows of ``horizons`` that fit.
    """
    # The per-ticker rows are small (one array per ticker) but explode into the
    # whole corpus, several hundred times their size. AQE would coalesce them by
    # their *input* bytes into a handful of tasks, so spread them explicitly over
    # the configured shuffle width: a numbered round-robin repartition is neither
    # coalesced nor elided (a hash repartition on ``ticker`` would be elided, the
    # rows already being hash-partitioned by ticker), and one row per ticker
    # balances exactly.
    width = int(prices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = prefix_series(prices).repartition(width).withColumn("n", F.size("closes"))
    rows = s.select("ticker", "closes", "close_texts", "units", "p1", "p2", "n",
                    F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    if every:
        windows = F.array(*[F.struct(F.lit(p).alias("pred_days"), F.lit(c).alias("context_days")) for p, c in horizons])
        rows = rows.withColumn("_w", F.explode(windows)).select("*", "_w.*").drop("_w")
    elif fixed is None:
        rows = choose_window(rows, seed, horizons)
    else:
        rows = rows.withColumn("pred_days", F.lit(fixed[1])).withColumn("context_days", F.lit(fixed[0]))
    return fitting(rows)


def fitting(rows: DataFrame) -> DataFrame:
    """Positions whose context and target lie inside the series of ``n`` rows."""
    return rows.where((F.col("i") >= F.col("context_days")) & (F.col("i") + F.col("pred_days") <= F.col("n")))


def ts_corpus(prices: DataFrame, seed: int = 42, horizons=K.CORPUS_HORIZONS,
              template: str = K.TRAINING_PROMPT, fixed: tuple[int, int] | None = None, every: bool = False) -> DataFrame:
    """``corpus(ticker, i, pred_days, context_days, text)`` -- one prompt per usable row (``every=True``: per window that fits).

    Per prompt the work is two prefix-sum lookups for the statistics plus the
    join of the pre-formatted close texts (the output itself).
    """
    rows = corpus_positions(prices, seed, horizons, fixed, every)
    return render_prompts(rows.withColumn("at", F.col("i")), template)


def render_prompts(rows: DataFrame, template: str = K.TRAINING_PROMPT) -> DataFrame:
    """Prompts of positions: ``i`` names the position, ``at`` is its place in the row's arrays (those of ``prefix_series``)."""
    # start clamped to 1: Catalyst may evaluate this before the fit filter
    start = F.greatest(F.col("at") - F.col("context_days") + 1, F.lit(1))
    ctx_text = F.array_join(F.slice("close_texts", start, F.col("context_days")), ", ")
    tgt_text = F.array_join(F.slice("close_texts", F.col("at") + 1, F.col("pred_days")), ", ")
    mean, std = window_moments(start - 1, F.col("context_days"))
    first = F.try_element_at("closes", start)
    last = F.try_element_at("closes", F.col("at"))
    text = render(template, ticker="ticker", mean=fmt2(mean), std_dev=fmt2(std), trend=trend2(first, last),
                  context_days=F.col("context_days").cast("string"), context=ctx_text,
                  pred_days=F.col("pred_days").cast("string"), target=tgt_text)
    return rows.select("ticker", "i", "pred_days", "context_days", text.alias("text"))


def fixed_window_corpus(prices: DataFrame, context_days: int = 60, pred_days: int = 5) -> DataFrame:
    """Notebook variant: fixed 60/5 windows and the static-example template."""
    return ts_corpus(prices, fixed=(context_days, pred_days), template=K.FIXED_WINDOW_PROMPT)


def filter_context(corpus: DataFrame, max_days: int = K.MAX_CONTEXT_DAYS_FILTER) -> DataFrame:
    """Keep prompts whose ``CONTEXT_DAYS`` tag is <= max_days; keep untagged prompts.

    A corpus built here carries ``context_days`` as a column (the tag is
    rendered from it), so the predicate uses the column: a predicate on the
    rendered text would be pushed below the rendering projection and inline
    the whole prompt expression into the filter. Text-only corpora (read back
    from JSONL) are filtered on the tag itself.
    """
    if "context_days" in corpus.columns:
        return corpus.where(F.col("context_days") <= max_days)
    n = context_tag("text")
    return corpus.where(n.isNull() | (n <= max_days))


def corpus_counts(corpus: DataFrame, max_days: int = K.MAX_CONTEXT_DAYS_FILTER) -> DataFrame:
    """total / kept / dropped per ticker plus a grand-total row (ticker NULL), one pass."""
    n = F.col("context_days") if "context_days" in corpus.columns else context_tag("text")
    keep = n.isNull() | (n <= max_days)
    return (corpus.rollup("ticker")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(keep).alias("kept"),
                 F.count_if(~keep).alias("dropped")))


def split_corpus(corpus: DataFrame, eval_fraction: float = K.EVAL_FRACTION, seed: int = K.SPLIT_SEED,
                 eval_cap: int = K.EVAL_CAP, key=("ticker", "i")) -> DataFrame:
    """Adds ``split`` in {train, eval, eval_overflow} and a shuffle order ``order_key``.

    Hash-based, so stable under re-partitioning. The eval side is capped at
    ``eval_cap`` rows in shuffle order; rows past the cap are labelled
    ``eval_overflow`` (the application drops them from both sides). The cap
    threshold is a distributed top-k (bounded by ``eval_cap``) evaluated as a
    scalar subquery.
    """
    kc = [F.col(c) for c in key]
    bucket = md5_bucket(F.lit(seed), *kc)
    order = md5_bucket(F.lit(seed), *kc, start=9)
    scale = 10000
    df = (corpus.withColumn("_is_eval", (bucket % scale) < int(round(eval_fraction * scale)))
          .withColumn("order_key", order))
    ev = df.where("_is_eval").select(F.struct("order_key", *key).alias("_o"))
    cutoff = ev.orderBy("_o").limit(eval_cap).select(F.max("_o")).scalar()
    o = F.struct("order_key", *key)
    split = (F.when(~F.col("_is_eval"), F.lit("train"))
             .when(o <= cutoff, F.lit("eval"))
             .otherwise(F.lit("eval_overflow")))
    return df.withColumn("split", split).drop("_is_eval")
