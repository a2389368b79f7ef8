"""Text rendering and parsing as Spark column expressions (JVM side, codegen).

* ``fmt2``: Python ``f"{x:.2f}"`` parity. ``format_number(x, '0.00')`` rounds the
  exact binary value half-even like Python does; ``format_string('%.2f')`` and
  ``round`` do not.
* ``render``: fills a ``{name}`` template with columns via one ``concat``.
* Parsers keep the application's regex quirks (minus signs ignored, ``3.`` is 3.0).
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def fmt2_strict(c) -> Column:
    """Two decimals, NULL stays NULL."""
    return F.call_function("format_number", col(c), F.lit("0.00"))


def fmt2(c) -> Column:
    """``f"{x:.2f}"``: two decimals, no grouping; ``nan`` for NULL (pandas NaN)."""
    return F.coalesce(fmt2_strict(c), F.lit("nan"))


def price_list_text(arr) -> Column:
    """``", ".join(f"{p:.2f}" for p in arr)`` over an array<double> column."""
    return F.array_join(F.transform(col(arr), fmt2_strict), ", ")


def py_list_text(arr) -> Column:
    """``str(list_of_floats)``: ``[1.5, 2.0]`` (shortest round-trip digits)."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(arr), py_float_text), ", "), F.lit("]"))


def py_float_text(x: Column) -> Column:
    """``repr(float)``: plain digits from 1e-4 up to 1e16, where the JVM writes an exponent below 1e-3 and from 1e7 on."""
    s = x.cast("string")
    plain = F.regexp_replace(x.cast("string").try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    parts = F.split(s, "E")
    power = F.try_element_at(parts, F.lit(2)).try_cast("int")
    far = F.concat(F.regexp_replace(F.try_element_at(parts, F.lit(1)), r"\.0$", ""), F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
            .when(~F.contains(s, F.lit("E")), s)
            .when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(far))


def placeholders(template: str) -> list[str]:
    return [f for _, f, _, _ in string.Formatter().parse(template) if f]


def render(template: str, **values) -> Column:
    """Fill ``{name}`` placeholders with columns (str -> column name, Column as is)."""
    parts: list[Column] = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field:
            v = values[field]
            parts.append(v if isinstance(v, Column) else F.col(v))
    return F.concat(*parts)


# ---------------------------------------------------------------------------
# parsers
# ---------------------------------------------------------------------------

def parse_prices(text, limit=None) -> Column:
    """All ``(\\d+\\.?\\d*)`` matches as doubles, truncated to ``limit`` items."""
    arr = F.transform(F.regexp_extract_all(col(text), F.lit(K.RE_PRICE), 1),
                      lambda s: s.try_cast("double"))
    if limit is not None:
        arr = F.slice(arr, F.lit(1), lit_or_col(limit))
    return arr


def parse_prices_loose(text) -> Column:
    """Older ``[\\d.]+`` parser: NULL array when any token fails to parse."""
    toks = F.regexp_extract_all(col(text), F.lit(K.RE_PRICE_LOOSE), 0)
    vals = F.transform(toks, lambda s: s.try_cast("double"))
    return F.when(F.exists(vals, lambda v: v.isNull()), F.lit(None)).otherwise(vals)


def loose_forecast_text(text) -> Column:
    """The prices behind the marker as a list's text, or the message that they can't be parsed (no marker, a token that is no number)."""
    return F.coalesce(py_list_text(parse_prices_loose(after_marker(text))), F.lit(K.MSG_LOOSE_PARSE))


def after_marker(text, marker: str = K.PREDICTION_MARKER) -> Column:
    """``text.split(marker)[1]`` -- NULL when the marker is absent."""
    return F.try_element_at(F.split(col(text), re.escape(marker)), F.lit(2))


def parse_label_pair(text) -> tuple[Column, Column]:
    """(sentiment_score, next_day_change) with 0.0 defaults."""
    s = F.regexp_extract(col(text), K.RE_SENTIMENT, 1)
    c = F.regexp_extract(col(text), K.RE_NEXT_CHANGE, 1)
    return (F.coalesce(F.nullif(s, F.lit("")).try_cast("double"), F.lit(0.0)),
            F.coalesce(F.nullif(c, F.lit("")).try_cast("double"), F.lit(0.0)))


def stock_tag(text) -> Column:
    """First ``STOCK: (\\S+)`` match or NULL."""
    return F.nullif(F.regexp_extract(col(text), K.RE_STOCK_TAG, 1), F.lit(""))


def context_tag(text) -> Column:
    """First ``CONTEXT_DAYS: (\\d+)`` match as int or NULL."""
    return F.nullif(F.regexp_extract(col(text), K.RE_CONTEXT_TAG, 1), F.lit("")).try_cast("int")


def strip(c) -> Column:
    """Python ``str.strip()`` on ASCII whitespace."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def summary_trim(s) -> Column:
    """Drop everything up to and including the first comma, then strip."""
    pos = F.instr(col(s), ",")
    return F.when(pos > 0, strip(F.substr(col(s), pos + 1))).otherwise(col(s))
