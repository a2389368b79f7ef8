"""Horizon lookup: requested days -> model horizon (rounded up) -> context rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import col


def horizon_table(spark, horizons=K.SERVING_HORIZONS) -> DataFrame:
    return spark.createDataFrame([(p, c) for p, c in horizons], "pred_days int, context_days int")


def resolve_horizon_expr(days, horizons=K.SERVING_HORIZONS, fallback: int = K.FALLBACK_CONTEXT_DAYS):
    """(model_days, context_days) columns for a fixed horizon list: a CASE chain.

    The smallest entry with ``pred_days >= days`` wins; beyond the table the
    requested days are kept with ``fallback`` context rows.
    """
    d = col(days)
    model = None
    ctx = None
    for p, c in sorted(horizons):
        model = F.when(d <= p, F.lit(p)) if model is None else model.when(d <= p, F.lit(p))
        ctx = F.when(d <= p, F.lit(c)) if ctx is None else ctx.when(d <= p, F.lit(c))
    return model.otherwise(d).cast("int"), ctx.otherwise(F.lit(fallback)).cast("int")


def resolve_horizon(requests: DataFrame, table: DataFrame | None = None, days: str = "prediction_days",
                    key: str = "request_id", fallback: int = K.FALLBACK_CONTEXT_DAYS) -> DataFrame:
    """Adds ``model_days`` and ``context_days`` to each request.

    With no ``table`` the fixed serving table is inlined as a CASE chain (no
    join at all). With a table DataFrame the distinct requested days are put
    among the table's, and each takes the nearest entry from its day on (a
    running ``first`` from above); the requests join the answer on their days.
    The ordered part holds distinct whole days only, however many requests there are.
    """
    if table is None:
        m, c = resolve_horizon_expr(days, fallback=fallback)
        return requests.withColumn("model_days", m).withColumn("context_days", c)
    entries = table.groupBy(F.col("pred_days").cast("int").alias("_d")).agg(F.min("context_days").alias("_c"))
    asked = requests.select(F.col(days).cast("int").alias("_d")).where(F.col(days).isNotNull()).distinct()
    above = Window.orderBy(F.col("_d").desc(), F.col("_c").isNull().asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = entries.select("_d", "_c", F.col("_d").alias("_p")).unionByName(
        asked.select("_d", F.lit(None).cast("int").alias("_c"), F.lit(None).cast("int").alias("_p")))
    found = both.select("_d", "_p", F.last("_c", ignorenulls=True).over(above).alias("_ctx"), F.last("_p", ignorenulls=True).over(above).alias("_model"))
    found = found.where(F.col("_p").isNull()).select("_d", "_ctx", "_model")
    j = requests.join(found, F.col(days).cast("int") == F.col("_d"), "left")
    return (j.withColumn("model_days", F.coalesce(F.col("_model"), F.col(days)).cast("int"))
            .withColumn("context_days", F.coalesce(F.col("_ctx"), F.lit(fallback)).cast("int"))
            .drop("_d", "_ctx", "_model"))


def validate_requests(requests: DataFrame, days: str = "prediction_days") -> DataFrame:
    """Adds ``error_message`` for horizons outside 1..90 (errors are rows)."""
    ok = F.col(days).between(K.MIN_PREDICTION_DAYS, K.MAX_PREDICTION_DAYS)
    return requests.withColumn("error_message", F.when(~ok | F.col(days).isNull(), F.lit(K.MSG_BAD_DAYS)))
