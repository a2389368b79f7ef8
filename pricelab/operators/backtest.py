"""Forecast vs actual: pairing by step, error metrics, directional accuracy.

Forecast and actual lists are per request and bounded (<= 90 steps), so
pairing and metrics are evaluated inside the row with higher-order functions
(``zip_with`` / ``aggregate``) -- no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def pair_arrays(forecast, actual) -> Column:
    """``array<struct<step, forecast, actual>>`` truncated to the shorter list."""
    f, a = col(forecast), col(actual)
    n = F.least(F.size(f), F.size(a))
    z = F.arrays_zip(F.slice(f, F.lit(1), n).alias("forecast"), F.slice(a, F.lit(1), n).alias("actual"))
    return F.transform(z, lambda s, k: F.struct((k + 1).alias("step"), s["forecast"].alias("forecast"),
                                                  s["actual"].alias("actual")))


def _mean(arr: Column) -> Column:
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x), F.size(arr))


def forecast_error(pairs) -> dict[str, Column]:
    """MAE, MAPE %, MSE, RMSE over paired steps (``error = forecast - actual``).

    MAPE is NULL when any actual is zero (the application would give inf).
    """
    p = col(pairs)
    err = F.transform(p, lambda s: s["forecast"] - s["actual"])
    mae = _mean(F.transform(err, lambda e: F.abs(e)))
    ape = F.transform(p, lambda s: F.try_divide(F.abs(s["forecast"] - s["actual"]), s["actual"]))
    mape = F.when(F.exists(ape, lambda x: x.isNull()), F.lit(None)).otherwise(_mean(ape) * 100)
    mse = _mean(F.transform(err, lambda e: e * e))
    return {"mae": mae, "mape": mape, "mse": mse, "rmse": F.sqrt(mse), "n_compared": F.size(p)}


def directional_accuracy(pairs) -> Column:
    """Share (%) of consecutive steps whose change has the same sign; 0 for < 2 steps.

    The move from the last known price to step 1 is not counted; equal zero
    changes count as agreeing.
    """
    p = col(pairs)
    n = F.size(p) - 1
    cur = F.slice(p, F.lit(2), F.greatest(n, F.lit(0)))
    prev = F.slice(p, F.lit(1), F.greatest(n, F.lit(0)))
    agree = F.zip_with(cur, prev, lambda c, q: F.when(
        F.signum(c["forecast"] - q["forecast"]) == F.signum(c["actual"] - q["actual"]), 1.0).otherwise(0.0))
    s = F.aggregate(agree, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 0, s / n * 100).otherwise(F.lit(0.0))


def outlook(forecast, last_close) -> Column:
    """``bullish`` when the mean forecast is above the last close, else ``bearish``."""
    return F.when(_mean(col(forecast)) > col(last_close), F.lit("bullish")).otherwise(F.lit("bearish"))


def pair_rows(forecasts: DataFrame, actuals: DataFrame, key: str = "request_id") -> DataFrame:
    """Row form: ``(key, step, forecast, actual)`` via posexplode + equi join on (key, step)."""
    f = forecasts.select(key, F.posexplode("forecast").alias("_k", "forecast"))
    a = actuals.select(key, F.posexplode("actual").alias("_k", "actual"))
    return (f.join(a, [key, "_k"], "inner")
            .select(key, (F.col("_k") + 1).cast("bigint").alias("step"), "forecast", "actual"))


def one_shot_example(ctx, h, example_len: int = 60) -> tuple[Column, Column]:
    """(example context, example continuation) from an ordered context list.

    The example ends ``h`` rows before the context end; NULL when fewer than
    ``example_len`` rows precede it.
    """
    a = col(ctx)
    hh = h if isinstance(h, Column) else F.lit(h)
    end = F.size(a) - hh
    ok = end >= example_len
    # starts are clamped: a slice may be evaluated before the condition around it
    ex_ctx = F.when(ok, F.slice(a, F.greatest(end - example_len + 1, F.lit(1)), F.lit(example_len)))
    ex_tgt = F.when(ok, F.slice(a, F.greatest(end + 1, F.lit(1)), F.greatest(hh, F.lit(0))))
    return ex_ctx, ex_tgt
