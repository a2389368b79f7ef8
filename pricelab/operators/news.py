"""Headline operators: selection, union/dedupe, joins to prices, quotas, levels.

``relevancy`` is the provider's rank: smaller = more relevant.

Skew: every per-group cap is written as ``row_number() <= constant`` so that
Catalyst plans a ``WindowGroupLimit`` *before* the shuffle (a hot ticker or day
is cut to the cap inside each map task). Dedupe is an aggregate (``min`` of a
struct), which also combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import next_change_pct, volatility_level, volatile_flag
from .features import W, W_ALL, abs_change_pct


def non_blank(headlines: DataFrame, title: str = "title") -> DataFrame:
    """Skip NULL and empty titles."""
    return headlines.where(F.col(title).isNotNull() & (F.col(title) != ""))


def lookback(headlines: DataFrame, asof, days: int, bounded: bool = True) -> DataFrame:
    """Headlines from ``asof - days`` (inclusive); up to ``asof`` when ``bounded``."""
    a = asof if isinstance(asof, Column) else (F.to_date(F.lit(str(asof))))
    cond = F.col("date") >= F.date_sub(a, days)
    if bounded:
        cond = cond & (F.col("date") <= a)
    return headlines.where(cond)


def cap_per_group(df: DataFrame, keys, cap: int, order=None) -> DataFrame:
    """First ``cap`` rows per group by ``order`` (relevancy, then title)."""
    order = order or [F.col("relevancy").asc(), F.col("title").asc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def select_news(headlines: DataFrame, asof=None, days: int = K.NEWS_LOOKBACK_DAYS, lang: str = "en",
                cap: int | None = K.NEWS_CAP, bounded: bool = True, keys=("ticker",), skip_blank: bool = True) -> DataFrame:
    """Language filter + look-back + top ``cap`` by relevancy per key, then without blank titles.

    A blank title counts against the cap, as an article of the provider's page
    does; ``skip_blank=False`` keeps it. ``asof`` may be a Column present on
    ``headlines`` (as-of per ticker); ``cap=None`` takes all.
    """
    h = headlines.where(F.col("lang") == lang) if lang else headlines
    if asof is not None:
        h = lookback(h, asof, days, bounded)
    if cap is not None:
        h = cap_per_group(h, list(keys), cap)
    return non_blank(h) if skip_blank else h


def union_headlines(a: DataFrame, b: DataFrame, keys=("ticker", "title")) -> DataFrame:
    """Union two sources and keep one row per (ticker, title): the earliest published.

    An aggregate of ``min(struct(published_at, source, relevancy, ...))``:
    partial aggregation before the shuffle, so a repeated title collapses map-side.
    """
    u = a.unionByName(b, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in keys and c != "published_at"]
    m = F.min(F.struct("published_at", *rest)).alias("_m")
    return u.groupBy(*keys).agg(m).select(*keys, "_m.*")


def join_news_prices(headlines: DataFrame, prices: DataFrame) -> DataFrame:
    """Headlines on a trading day of their ticker (weekend news is dropped)."""
    return headlines.join(prices.select("ticker", "date", "close"), ["ticker", "date"], "inner")


def next_day_change(headlines: DataFrame, prices: DataFrame) -> DataFrame:
    """Same-day join + next trading close: ``(next / current - 1) * 100``.

    ``lead`` runs on the price series before the join, so the headline side is
    never sorted by the window; headlines without a next bar are dropped.
    """
    p = (prices.select("ticker", "date", "close", F.lead("close").over(W()).alias("next_close"))
         .where(F.col("next_close").isNotNull()))
    j = headlines.join(p, ["ticker", "date"], "inner")
    return j.withColumn("next_day_change", next_change_pct("close", "next_close"))


def asof_forward(headlines: DataFrame, prices: DataFrame) -> DataFrame:
    """For each headline, the first trading bar strictly after its date.

    Skew-safe in two steps:

    1. The as-of search runs on the *distinct* (ticker, headline date) keys
       only -- at most one per calendar day -- unioned with the bars, ordered by
       date descending with the key before the bar of the same day;
       ``last(close, ignorenulls)`` over the growing frame ``unbounded preceding
       .. 1 preceding`` is then the nearest later bar (a running aggregate,
       O(n) per ticker). A ticker with a huge number of headlines does not
       grow this window partition.
    2. The answer is equi-joined back to the headlines on (ticker, date), a
       join AQE can split if one key is hot.
    """
    keys = headlines.select("ticker", "date").distinct()
    k = keys.select("ticker", "date", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_close"),
                    F.lit(None).cast("date").alias("_bdate"))
    bars = prices.select("ticker", "date", F.lit(1).alias("_kind"), F.col("close").alias("_close"),
                         F.col("date").alias("_bdate"))
    w = (Window.partitionBy("ticker").orderBy(F.col("date").desc(), F.col("_kind").asc())
         .rowsBetween(Window.unboundedPreceding, -1))
    nxt = (k.unionByName(bars)
           .select("ticker", "date", "_kind", F.last("_close", ignorenulls=True).over(w).alias("next_close"),
                   F.last("_bdate", ignorenulls=True).over(w).alias("next_date"))
           .where(F.col("_kind") == 0).drop("_kind"))
    return headlines.join(nxt, ["ticker", "date"], "left")


def volatility_levels(prices: DataFrame, probs=(0.25, 0.75)) -> DataFrame:
    """``(ticker, date, close, price_change_pct, q25, q75, volatility, is_volatile)``."""
    ch = abs_change_pct(prices)
    # exact quantiles as whole-partition window aggregates: no second aggregate + join
    q = F.percentile(F.col("price_change_pct").cast("double"), F.array(*[F.lit(p) for p in probs])).over(W_ALL())
    j = ch.withColumn("_q", q).select("*", *[F.col("_q")[k].alias(f"q{int(round(p * 100))}")
                                             for k, p in enumerate(probs)]).drop("_q")
    return (j.withColumn("volatility", volatility_level("price_change_pct", "q25", "q75"))
            .withColumn("is_volatile", volatile_flag("price_change_pct", "q75")))


def attach_level(headlines: DataFrame, levels: DataFrame) -> DataFrame:
    """Headline date -> volatility level of that day, default ``low``."""
    lv = levels.select("ticker", "date", "volatility")
    return (headlines.join(lv, ["ticker", "date"], "left")
            .withColumn("volatility", F.coalesce("volatility", F.lit("low"))))


def flag_volatile(headlines: DataFrame, levels: DataFrame) -> DataFrame:
    """``is_volatile``: headline date is one of the ticker's volatile days."""
    vd = levels.where("is_volatile").select("ticker", "date", F.lit(True).alias("is_volatile"))
    return (headlines.join(vd, ["ticker", "date"], "left")
            .withColumn("is_volatile", F.coalesce("is_volatile", F.lit(False))))


def quota_by_level(level: Column) -> Column:
    expr = None
    for name, n in K.VOLATILITY_TO_ARTICLE_COUNT:
        expr = F.when(level == name, F.lit(n)) if expr is None else expr.when(level == name, F.lit(n))
    return expr.otherwise(F.lit(dict(K.VOLATILITY_TO_ARTICLE_COUNT)["low"]))


def quota_news(headlines: DataFrame, quota: Column, max_quota: int) -> DataFrame:
    """Per (ticker, date) keep the first ``quota`` headlines; ``quota`` is a column.

    The constant ``max_quota`` bound lets Catalyst limit each group map-side.
    """
    w = Window.partitionBy("ticker", "date").orderBy(F.col("relevancy").asc(), F.col("title").asc())
    x = headlines.withColumn("_quota", quota).withColumn("_rn", F.row_number().over(w))
    return x.where(F.col("_rn") <= max_quota).where(F.col("_rn") <= F.col("_quota")).drop("_rn")


def news_match(headlines: DataFrame, companies: DataFrame) -> DataFrame:
    """``"<company>" OR <ticker>`` of headlines that carry a candidate ticker: adds ``matched``.

    ``companies(ticker, name)`` is joined on the candidate ticker: a headline
    matches when its title contains the company name (case-insensitive) or the
    ticker as a word of its own.
    """
    name = F.lower(F.coalesce(F.col("name"), F.col("ticker")))
    j = headlines.join(companies, "ticker", "left")
    hit = F.contains(F.lower("title"), name) | F.array_contains(title_words("title"), F.col("ticker"))
    return j.withColumn("matched", F.coalesce(hit, F.lit(False)))


def title_words(title) -> Column:
    """The words of a title as they stand: runs of letters, digits and the signs inside tickers (``BRK.B``, ``^GSPC``).

    A sentence's last full stop and other outer signs are no part of a word.
    """
    words = F.regexp_extract_all(F.col(title) if isinstance(title, str) else title, F.lit(r"\^?[\p{L}\p{N}_]+(?:[.\-=][\p{L}\p{N}_]+)*"), 0)
    parts = F.regexp_extract_all(F.col(title) if isinstance(title, str) else title, F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.array_union(words, parts)


def name_tokens(text) -> Column:
    """The lower-case words of a name or title, in order."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def news_search(headlines: DataFrame, companies: DataFrame) -> DataFrame:
    """``"<company>" OR <ticker>`` over headlines without a ticker: one row for each headline and company found.

    ``companies(ticker, name)``; a missing name is the ticker. A headline is found if the ticker is one of its words, or
    if the name's words stand in it side by side, whatever their case. No pattern is built from data:

    1. The headlines are numbered and written; their different words are an inverted index (word, number), and each
       word's headlines are counted.
    2. A name is looked up by its rarest word, so "The Home Depot" meets the headlines with "depot", not those with
       "the"; a name with a word that no headline has is found nowhere.
    3. Candidates fetch the title by its number, and the name's words are compared in order.

    Repeated headlines are a row each.
    """
    from ..session import scratch_path

    spark = headlines.sparkSession
    path = scratch_path(spark, "headlines")
    headlines.drop("ticker").withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    h = spark.read.parquet(path)
    words = h.select("_id", F.explode(F.array_distinct(name_tokens("title"))).alias("_word"))
    c = companies.select("ticker", name_tokens(F.coalesce("name", "ticker")).alias("_name")).distinct()
    parts = c.where(F.size("_name") > 0).select("ticker", "_name", F.posexplode("_name").alias("_k", "_word"))
    often = words.join(parts.select("_word").distinct(), "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_n"))
    rare = parts.join(often, "_word", "left").groupBy("ticker", "_name").agg(
        F.min_by("_word", F.struct(F.coalesce("_n", F.lit(0)), "_k")).alias("_word"), F.min(F.coalesce("_n", F.lit(0))).alias("_n"))
    by_name = words.join(rare.where("_n > 0").select("ticker", "_name", "_word"), "_word").select("_id", "ticker", "_name")
    signs = h.select("_id", F.explode(F.array_distinct(title_words("title"))).alias("_word"))
    by_ticker = signs.join(companies.select("ticker", F.col("ticker").alias("_word")).distinct(), "_word")
    by_ticker = by_ticker.select("_id", "ticker", F.lit(None).cast("array<string>").alias("_name"))
    inside = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    found = by_name.unionByName(by_ticker).join(h, "_id")
    found = found.where(F.col("_name").isNull() | F.contains(inside(name_tokens("title")), inside("_name")))
    return found.drop("_name").dropDuplicates(["_id", "ticker"]).drop("_id")


def headline_block(labelled: DataFrame, label: str = "_lab", keys=("ticker",), error: str | None = None) -> DataFrame:
    """``(keys.., n_headlines, headline_block)``: bulleted ``'<title>' (Sentiment: X, Score: 0.93)`` lines.

    ``label`` is a ``struct<label, score, error>`` column; ``error`` names a column for the first error of a block. Lines are sorted by (date,
    title); a block is one prompt, so its list is as long as the selection upstream lets it be.
    """
    from ..functions.text import fmt2, render

    line = render(K.HEADLINE_LINE, title="title", label=F.initcap(F.col(f"{label}.label")),
                  score=fmt2(F.col(f"{label}.score")))
    lines = labelled.select(*keys, "date", "title", F.concat(F.lit("- "), line).alias("line"), *([F.col(f"{label}.error").alias(error)] if error else []))
    failed = [F.min(error).alias(error)] if error else []
    agg = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "title", "line"))).alias("_l"), *failed)
    return agg.select(*keys, *([error] if error else []), F.size("_l").cast("bigint").alias("n_headlines"),
                      F.array_join(F.col("_l.line"), "\n").alias("headline_block"))
