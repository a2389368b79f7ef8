"""Resume: what is left to process, given what an output already holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(universe: DataFrame, done: DataFrame, key: str = "ticker") -> DataFrame:
    """Universe rows whose key is not in ``done`` (anti join on the distinct done keys)."""
    return universe.join(done.select(key).distinct(), key, "left_anti")


def remaining_after(universe: DataFrame, done: DataFrame, key: str = "ticker", pos: str = "pos") -> DataFrame:
    """Universe rows positioned after the last processed one; none processed -> all rows.

    The last position is an uncorrelated scalar subquery (one value), not a
    driver round trip.
    """
    last = universe.join(done.select(key).distinct(), key, "left_semi").select(F.max(pos)).scalar()
    return universe.where(F.col(pos) > F.coalesce(last, F.lit(-1)))
