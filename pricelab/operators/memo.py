"""Inference memo: a content-addressed table of model answers.

A prompt's answer is kept under (model name, sha256 of the prompt). Before a model
is called the distinct prompts are anti-joined with what the table holds; only
the others are sent, each once however many rows ask it, and their answers are
appended afterwards. Errors are not kept, so the next run tries those prompts again.

An ordered fold is kept step by step, under the digest of all that the step
depends on: model, template, start and every chunk up to it. A second run, or one whose series has
grown, goes on behind the last step that it finds.

The table is Parquet, partitioned by model, in a folder that the caller owns.
Answers are written to the session's scratch folder first: the append and the
result read them from there, and a lost executor repeats no call that ended.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import scratch_path
from . import models as M

SCHEMA = "digest string, value string, model string"


def recalled(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(digest, value) of a model's answers; one each, though two runs at once may have appended the same."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:  # nothing kept yet
        rows = spark.createDataFrame([], SCHEMA)
    return rows.where(F.col("model") == name).groupBy("digest").agg(F.min("value").alias("value"))


def keep(answers: DataFrame, path: str, name: str) -> None:
    """Append (digest, value) rows."""
    answers.select("digest", "value").withColumn("model", F.lit(name)).write.mode("append").partitionBy("model").parquet(path)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def generate(df: DataFrame, prompt: str, out: str, factory: Callable[[], M.TextModel], path: str, name: str | None = None,
             error: str | None = None, recalled_as: str | None = None) -> DataFrame:
    """As ``models.generate``, by way of the memo in ``path``.

    ``name`` stands for the model (by default its code's digest); ``recalled_as`` names a boolean column, true where no
    call was made in this run. ``df`` is read twice, for its prompts and for its rows.
    """
    spark, name, d = df.sparkSession, name or M.model_id(factory), f"_d{uuid.uuid4().hex[:8]}"
    digest = F.sha2(F.col(prompt).cast("binary"), 256)
    asked = df.where(F.col(prompt).isNotNull()).groupBy(digest.alias("digest")).agg(F.min(prompt).alias("_prompt"))
    known = recalled(spark, path, name)
    new = M.generate(M.spread(asked.join(known, "digest", "left_anti")), "_prompt", "value", factory, "error")
    new = _written(new.select("digest", "value", "error"), "answers")
    both = known.select("digest", "value", F.lit(None).cast("string").alias("error"), F.lit(True).alias("known"))
    both = both.unionByName(new.withColumn("known", F.lit(False)))
    rows = df.withColumn(d, digest).join(both.select(F.col("digest").alias(d), F.col("value").alias(d + "v"), F.col("error").alias(d + "e"), F.col("known").alias(d + "k")), d, "left")
    rows = _written(rows, "answered")  # before the append: ``known`` is what this run found
    keep(new.where("error is null"), path, name)
    for column, c in ((out, d + "v"), (error, d + "e"), (recalled_as, d + "k")):
        rows = rows.withColumn(column, F.col(c)) if column else rows
    return rows.drop(d, d + "v", d + "e", d + "k")


def chained(chunks: DataFrame, key: str, order: str, text: str, start: str) -> DataFrame:
    """(key, order, text, digest): the digest of ``start`` and all chunks up to each."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        h, out = start.encode(), []
        for t in pdf[text].tolist():
            h = hashlib.sha256(h + hashlib.sha256((t or "").encode()).digest()).digest()
            out.append(h.hex())
        return pdf.assign(digest=out)

    types = dict(chunks.dtypes)
    return chunks.select(key, order, text).groupBy(key).applyInPandas(chain, f"{key} {types[key]}, {order} {types[order]}, {text} string, digest string")


def ordered_fold(chunks: DataFrame, key: str, order: str, text: str, factory: Callable, path: str, name: str | None = None,
                 init: str = K.INITIAL_SUMMARY, template: str = K.SUMMARIZER_PROMPT) -> DataFrame:
    """(key, summary, error, n_called): as ``pipelines.ordered_fold``, behind the last step that the memo in ``path`` holds."""
    spark, name = chunks.sparkSession, name or M.model_id(factory)
    steps = chained(chunks, key, order, text, "\0".join((name, template, init)))
    steps = steps.join(recalled(spark, path, name), "digest", "left")
    types = dict(chunks.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        values = [v if isinstance(v, str) else None for v in pdf["value"]]
        at = max((k + 1 for k, v in enumerate(values) if v is not None), default=0)
        summary, error, out = values[at - 1] if at else init, None, []
        for t, digest in zip(pdf[text].tolist()[at:], pdf["digest"].tolist()[at:]):
            summary, error = M.fold_step(name, factory, template.format(prior=summary, chunk=t), summary)
            if error:
                break
            out.append((digest, summary))
        rows = [(None, None), *out]  # the first row is the series' own
        return pd.DataFrame({key: pdf[key].iloc[0], "digest": [d for d, _ in rows], "value": [v for _, v in rows],
                             "summary": [summary] + [None] * len(out), "error": [error] + [None] * len(out), "n_called": len(out) + bool(error)})

    done = M.spread(steps, key).groupBy(key).applyInPandas(fold, f"{key} {types[key]}, digest string, value string, summary string, error string, n_called long")
    done = _written(done, "folded")
    keep(done.where("digest is not null"), path, name)
    return done.where("digest is null").select(key, F.when(F.col("error").isNull(), F.col("summary")).alias("summary"), "error", "n_called")
