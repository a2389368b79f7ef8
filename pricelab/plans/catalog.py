"""Registry of runnable queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the given
tables (through the derived fixture tables). Output columns are aliased to the
same names in both formulations; doubles are rounded to 6 places and counts /
positions are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from ..sources import tables as T
from .oracle import with_ctes

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql, *ctes)
        return fn

    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


_BARS: dict[tuple, str] = {}


class Ctx:
    """Per-call access to the fixture tables.

    The bars are written once to the shared folder for an application, a state
    of the files that they come from and a time zone: most queries use them two
    to four times (the latest date, the windows, the requests), and each use
    would read all of ``lineitem`` again.
    """

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self._bars: DataFrame | None = None

    def bars(self) -> DataFrame:
        if self._bars is None:
            made = T.bars(self.spark, self.sf)
            key = (self.spark.sparkContext.applicationId, ensure_checkpoint_dir(self.spark), self.sf,
                   self.spark.conf.get("spark.sql.session.timeZone"), T.files_state(self.spark, self.sf, "lineitem", "part"))
            if key not in _BARS:
                path = scratch_path(self.spark, "bars")
                made.write.parquet(path)
                _BARS[key] = path
            self._bars = self.spark.read.schema(made.schema).parquet(_BARS[key])
        return self._bars

    def headlines(self) -> DataFrame:
        return T.headlines(self.spark, self.sf)

    def requests(self) -> DataFrame:
        return T.requests(self.spark, self.sf, self.bars())


# modules that register queries (import for side effects)
from . import queries_core, queries_corpus, queries_news, queries_serving, queries_pipelines, queries_io, queries_stream, queries_indicators, queries_models, queries_variants  # noqa: E402,F401
