"""Scalar column functions (dates, trends, flags, URL parsing).

All built from ``pyspark.sql.functions`` so they stay inside whole-stage codegen.
``try_*`` variants are used wherever ANSI mode would raise on bad input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import col, lit_or_col


def ticker_from_url(url) -> Column:
    """Last non-empty part of the URL path (query string and fragment ignored); NULL for what is no URL."""
    path = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.try_element_at(parts, F.lit(-1))


def ticker_from_url_split(url) -> Column:
    """Plain ``/`` split variant: last part stripped, else the one before (query kept)."""
    parts = F.split(col(url), "/")
    last = F.trim(F.try_element_at(parts, F.lit(-1)))
    prev = F.trim(F.try_element_at(parts, F.lit(-2)))
    return F.when(last != "", last).otherwise(prev)


def norm_date(c) -> Column:
    """Timestamp / ISO timestamp string / date -> date (text before ``T``)."""
    return F.to_date(F.split(col(c).cast("string"), "T").getItem(0))


def date_text(c) -> Column:
    """date -> ``YYYY-MM-DD``."""
    return F.date_format(col(c), "yyyy-MM-dd")


def trend2(first, last) -> Column:
    """``upward`` when last > first, else ``downward`` (flat is downward)."""
    return F.when(col(last) > col(first), F.lit("upward")).otherwise(F.lit("downward"))


def trend3(first, last, threshold: float = K.STABILITY_THRESHOLD_PCT) -> Column:
    """Percent change of the first price; |change| < threshold -> ``stable``."""
    pct = F.when(col(first) > 0, (col(last) - col(first)) / col(first) * 100).otherwise(F.lit(0.0))
    return (F.when(F.abs(pct) < threshold, F.lit("stable"))
            .when(col(last) > col(first), F.lit("upward"))
            .otherwise(F.lit("downward")))


def volatility_level(change, q25, q75) -> Column:
    """``high`` >= q75, ``medium`` >= q25, else ``low`` (NULL input -> ``low``)."""
    return (F.when(col(change) >= col(q75), F.lit("high"))
            .when(col(change) >= col(q25), F.lit("medium"))
            .otherwise(F.lit("low")))


def volatile_flag(change, q75) -> Column:
    return F.coalesce(col(change) >= col(q75), F.lit(False))


def unreliable_jump(arr, low: float = K.JUMP_LOW, high: float = K.JUMP_HIGH) -> Column:
    """Any step below ``low`` x or above ``high`` x the previous element."""
    a = col(arr)
    n = F.size(a)
    pairs = F.zip_with(F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))),
                       lambda b, p: (b < p * low) | (b > p * high))
    return F.coalesce(F.exists(pairs, lambda x: x), F.lit(False))


def step_delta(arr) -> Column:
    """Consecutive differences ``a[k+1] - a[k]``."""
    a = col(arr)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), lambda b, p: b - p)


def step_ratio(arr) -> Column:
    """Consecutive ratios ``a[k+1] / a[k]`` (NULL on a zero divisor)."""
    a = col(arr)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), lambda b, p: F.try_divide(b, p))


def forecast_dates(last_date, k) -> Column:
    """``last_date + 1 .. last_date + k`` calendar days (weekends included)."""
    kk = lit_or_col(k)
    return F.when(kk >= 1, F.transform(F.sequence(F.lit(1), kk), lambda d: F.date_add(col(last_date), d))) \
        .otherwise(F.array().cast("array<date>"))


def period_bucket(context_days) -> Column:
    """Context rows -> vendor period token."""
    c = col(context_days)
    expr = None
    for bound, token in K.PERIOD_BY_CONTEXT:
        expr = F.when(c <= bound, F.lit(token)) if expr is None else expr.when(c <= bound, F.lit(token))
    return expr.otherwise(F.lit("5y"))


def period_months(token) -> Column:
    """Period token -> months (NULL for an unknown token)."""
    t = col(token)
    expr = None
    for tok, months in K.PERIOD_MONTHS:
        expr = F.when(t == tok, F.lit(months)) if expr is None else expr.when(t == tok, F.lit(months))
    return expr


def clean_title(c) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def next_change_pct(current, nxt) -> Column:
    """``(next / current - 1) * 100``; NULL on a zero current price."""
    return (F.try_divide(col(nxt), col(current)) - 1) * 100


def pct_return(prev, cur) -> Column:
    """``cur / prev - 1``; NULL when prev is NULL or zero."""
    return F.try_divide(col(cur), col(prev)) - 1
