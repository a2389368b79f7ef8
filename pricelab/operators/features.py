"""Per-ticker window features over daily bars.

All windows are ``partitionBy('ticker').orderBy('date')`` so that several
features over the same spec share one exchange and one sort. Time is the row
position (trading days), never the calendar: frames are ``rowsBetween``.

Scale note: bars are unique per (ticker, date), so a ticker partition holds at
most one row per calendar day of the period (about 1,260 rows for five years
of trading days) no matter how large the raw input is -- the window partitions
are bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import pct_return, period_months



def W():
    """Per-ticker window in date order."""
    return Window.partitionBy("ticker").orderBy("date")


def W_DESC():
    return Window.partitionBy("ticker").orderBy(F.col("date").desc())


def W_ALL():
    return Window.partitionBy("ticker")


def price_history(prices: DataFrame, period: str | None = "5y", asof=None) -> DataFrame:
    """Bars of the trailing ``period`` (``1mo`` .. ``5y``) before ``asof``.

    ``asof`` defaults to the latest date in the table (the data's "today"),
    planned as an uncorrelated scalar subquery; the date predicate is pushed
    into the Parquet scan when ``prices`` is a plain scan.
    """
    if period is None:
        return prices
    months = dict(K.PERIOD_MONTHS)[period]
    if asof is None:
        asof_col = prices.select(F.max("date")).scalar()
    elif isinstance(asof, Column):
        asof_col = asof
    else:
        asof_col = F.to_date(F.lit(str(asof)))
    return prices.where(F.col("date") > F.add_months(asof_col, -months))


def price_history_by_request(prices: DataFrame, requests: DataFrame, token: str = "period", asof=None, key: str = "request_id") -> DataFrame:
    """``(key, prices' columns)``: for each request the bars of its ticker in the period that its token names.

    ``requests(key, ticker, token)``; an unknown token has no bars. One pass for all: the different
    (ticker, from, to) spans are cut into months, joined with the bars of (ticker, month), and only bars of
    the first month are compared by day. Requests of one span share its bars, and a ticker that very
    many ask is split by adaptive execution, since requests are joined last.
    """
    to = prices.select(F.max("date")).scalar() if asof is None else asof if isinstance(asof, Column) else F.to_date(F.lit(str(asof)))
    asked = requests.select(key, "ticker", F.add_months(to, -period_months(token)).alias("_from"), to.alias("_to")).where(F.col("_from").isNotNull())
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    spans = asked.select("ticker", "_from", "_to").distinct()
    spans = spans.withColumn("_month", F.explode(F.sequence(month("_from"), month("_to"))))
    bars = prices.withColumn("_month", month("date")).join(spans, ["ticker", "_month"])
    bars = bars.where((F.col("date") > F.col("_from")) & (F.col("date") <= F.col("_to"))).drop("_month")
    return asked.join(bars, ["ticker", "_from", "_to"]).select(key, *prices.columns)


def moving_average(prices: DataFrame, n: int = K.MA_WINDOW, out: str = "ma_20") -> DataFrame:
    """n-row simple moving average of ``close``; NULL until n non-NULL closes are in the frame.

    Counting non-NULL closes (not rows) gives pandas ``rolling(n).mean()`` semantics:
    every window that contains a missing close has no average.
    """
    frame = W().rowsBetween(-(n - 1), 0)
    return prices.withColumn(out, F.when(F.count("close").over(frame) == n, F.avg("close").over(frame)))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value."""
    return df.na.drop("any")


def one_bar_per_day(prices: DataFrame, order: str | None = None) -> DataFrame:
    """One row per (ticker, date): the last by ``order`` (a delivery number), then by the row's values.

    A lead over the window that the next steps use too, in a finer order: no
    exchange and no sort of its own. A feed that repeats days without bound is
    better aggregated by (ticker, date) before, as ``sources.tables.bars`` does.
    """
    ties = [c for c in ([order] if order else []) + prices.columns if c not in ("ticker", "date")]
    following = F.lead("date").over(Window.partitionBy("ticker").orderBy("date", *dict.fromkeys(ties)))
    return prices.withColumn("_next", following).where(~F.col("_next").eqNullSafe(F.col("date"))).drop("_next")


def ingest(bars: DataFrame, period: str | None = "5y", asof=None) -> DataFrame:
    """Trailing period -> one bar per day -> MA20 -> drop incomplete rows (the ingestion feature step)."""
    return drop_incomplete(moving_average(one_bar_per_day(price_history(bars, period, asof))))


def daily_return(prices: DataFrame, out: str = "returns") -> DataFrame:
    """Row-over-row return ``close / prev - 1``; NULL on the first row or zero prev."""
    return prices.withColumn(out, pct_return(F.lag("close").over(W()), F.col("close")))


def abs_change_pct(prices: DataFrame, out: str = "price_change_pct") -> DataFrame:
    """``abs(return) * 100``; NULL on the first row."""
    return prices.withColumn(out, F.abs(pct_return(F.lag("close").over(W()), F.col("close"))) * 100)


def with_position(prices: DataFrame) -> DataFrame:
    """Adds ``i`` (0-based row position) and ``n`` (rows of the ticker)."""
    return (prices.withColumn("i", (F.row_number().over(W()) - 1).cast("int"))
            .withColumn("n", F.count(F.lit(1)).over(W_ALL()).cast("int")))


def with_reverse_rank(prices: DataFrame, out: str = "rn") -> DataFrame:
    """``rn`` = 1 for the latest row of each ticker."""
    return prices.withColumn(out, F.row_number().over(W_DESC()))


def tail_n(prices: DataFrame, n) -> DataFrame:
    """Last ``n`` rows per ticker. A constant ``n`` is planned as WindowGroupLimit.

    ``n`` may also be a column name / Column (per request).
    """
    if isinstance(n, int):
        return with_reverse_rank(prices, "_rn").where(F.col("_rn") <= n).drop("_rn")
    nn = F.col(n) if isinstance(n, str) else n
    return with_reverse_rank(prices, "_rn").where(F.col("_rn") <= nn).drop("_rn")


def holdout_split(prices: DataFrame, h) -> DataFrame:
    """Adds ``part`` = ``truth`` for the last ``h`` rows and ``context`` for the rest."""
    hh = F.lit(h) if isinstance(h, int) else (F.col(h) if isinstance(h, str) else h)
    return (with_reverse_rank(prices, "_rn")
            .withColumn("part", F.when(F.col("_rn") <= hh, F.lit("truth")).otherwise(F.lit("context")))
            .drop("_rn"))


def context_frame(prices: DataFrame, c: int, out: str = "context") -> DataFrame:
    """Previous ``c`` closes, excluding the current row (NULL-free list, may be short)."""
    return prices.withColumn(out, F.collect_list("close").over(W().rowsBetween(-c, -1)))


def target_frame(prices: DataFrame, p: int, out: str = "target") -> DataFrame:
    """Current close and the following ``p - 1`` closes."""
    return prices.withColumn(out, F.collect_list("close").over(W().rowsBetween(0, p - 1)))


def require_history(df: DataFrame, need, mode: str = "drop") -> DataFrame:
    """Keep tickers with at least ``need`` rows (``mode='flag'`` adds ``enough``)."""
    nn = F.lit(need) if isinstance(need, int) else (F.col(need) if isinstance(need, str) else need)
    flagged = df.withColumn("_n", F.count(F.lit(1)).over(W_ALL())).withColumn("enough", F.col("_n") >= nn).drop("_n")
    if mode == "flag":
        return flagged
    return flagged.where("enough").drop("enough")


def change_quantiles(df: DataFrame, col: str = "price_change_pct", probs=(0.25, 0.75)) -> DataFrame:
    """Exact linearly interpolated quantiles per ticker (pandas ``quantile`` parity).

    ``percentile`` is exact and keeps a per-ticker buffer bounded by the bars
    of the ticker (one per day); ``percentile_approx`` is not equivalent.
    """
    q = F.percentile(F.col(col).cast("double"), F.array(*[F.lit(p) for p in probs]))
    out = df.groupBy("ticker").agg(q.alias("_q"))
    return out.select("ticker", *[F.col("_q")[k].alias(f"q{int(round(p * 100))}") for k, p in enumerate(probs)])


def overlap_chunk_count(n: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Chunks produced by the overlapping-chunk loop for ``n`` rows (closed form)."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    stride = size - overlap
    return (F.when(n <= 0, F.lit(0))
            .when(n <= size, F.lit(1))
            .otherwise(F.ceil((n - size) / F.lit(stride)).cast("int") + 1))


def overlap_chunks(series: DataFrame, arr: str = "closes", size: int = K.CHUNK_SIZE,
                   overlap: int = K.CHUNK_OVERLAP, keys=("ticker",)) -> DataFrame:
    """``(keys.., chunk_no, chunk)`` rows; chunk k covers rows ``k*stride .. k*stride+size-1``."""
    stride = size - overlap
    n = F.size(arr)
    cnt = overlap_chunk_count(n, size, overlap)
    return (series.select(*keys, arr, F.explode(F.sequence(F.lit(0), cnt - 1)).alias("chunk_no"))
            .where(cnt > 0)
            .select(*keys, "chunk_no",
                    F.slice(arr, F.col("chunk_no") * stride + 1, F.lit(size)).alias("chunk"))
            .withColumn("chunk_no", F.col("chunk_no").cast("int")))


def series_arrays(prices: DataFrame, value: str = "close", keys=("ticker",), with_dates: bool = False) -> DataFrame:
    """One row per key: values ordered by date, plus first/last dates (and all dates).

    The list per ticker is bounded by the calendar (one bar per day), which is
    what makes collecting it into one row safe.
    """
    s = F.array_sort(F.collect_list(F.struct("date", value)))
    out = prices.groupBy(*keys).agg(s.alias("_s"))
    cols = [F.col(f"_s.{value}").alias(value + "s"), F.col("_s")[0]["date"].alias("first_date"),
            F.try_element_at("_s", F.lit(-1))["date"].alias("last_date")]
    if with_dates:
        cols.append(F.col("_s.date").alias("dates"))
    return out.select(*keys, *cols)


def last_n(arr, n) -> Column:
    """The last ``n`` elements of an array, all of a shorter one."""
    a = F.col(arr) if isinstance(arr, str) else arr
    nn = n if isinstance(n, Column) else F.lit(n)
    return F.slice(a, F.greatest(F.size(a) - nn + 1, F.lit(1)), nn)


def distinct_tickers(df: DataFrame, col: str = "ticker") -> DataFrame:
    return df.select(col).distinct()


def last_actual(prices: DataFrame) -> DataFrame:
    """``(ticker, last_date, last_close)``: one partial+final aggregate per ticker."""
    return prices.groupBy("ticker").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))


def prices_for(requests: DataFrame, series: DataFrame, how: str = "left") -> DataFrame:
    """Attach each request's ticker series (one row per ticker) -- the batch form of one call per stock."""
    return requests.join(series, "ticker", how)
