"""Injected models behind Arrow-batched pandas UDFs.

A model is a *factory* returning a callable ``list[str] -> list[...]``. The
factory runs once per Python worker (iterator UDF), the callable once per
Arrow batch. The registered queries use the test doubles of ``plans.standins``.

A model's exception is a value, not the end of the job: a batch that fails is
halved until the failing prompts are alone, those are tried once more, and what
they raise becomes their row's error; all other rows get their answers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TextModel = Callable[[list[str]], list[str]]

TRIES = 2  # of a single prompt


def attempt(model: Callable[[list[str]], list], prompts: list[str], tries: int = TRIES) -> tuple[list, list[str | None]]:
    """(answers, errors) of a batch, one of each for every prompt; an answer is None where there is an error."""
    try:
        out = list(model(prompts))
        if len(out) != len(prompts):
            raise ValueError(f"the model gave {len(out)} answers to {len(prompts)} prompts")
        return out, [None] * len(out)
    except Exception as e:  # noqa: BLE001 -- whatever a model raises is its prompt's error
        if len(prompts) > 1:
            half = len(prompts) // 2
            parts = attempt(model, prompts[:half], tries), attempt(model, prompts[half:], tries)
            return parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]
        return attempt(model, prompts, tries - 1) if tries > 1 else ([None], [str(e) or type(e).__name__])


def _answered(batches: Iterator[pd.Series], factory: Callable) -> Iterator[tuple[list, list]]:
    """Answers and errors of every batch; a NULL prompt makes no model call."""
    model = None
    for s in batches:
        vals = s.tolist()
        idx = [k for k, v in enumerate(vals) if v is not None]
        outs, errors = [None] * len(vals), [None] * len(vals)
        if idx:
            try:
                model = model or factory()
                got, bad = attempt(model, [vals[k] for k in idx])
            except Exception as e:  # noqa: BLE001 -- the model can't be made
                got, bad = [None] * len(idx), [str(e) or type(e).__name__] * len(idx)
            for k, o, e in zip(idx, got, bad):
                outs[k], errors[k] = o, e
        yield outs, errors


TEXT_TYPE = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])


def text_udf(factory: Callable[[], TextModel]):
    """prompt column -> struct<value, error>."""

    @F.pandas_udf(TEXT_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for outs, errors in _answered(batches, factory):
            yield pd.DataFrame({"value": pd.Series(outs, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run


LABEL_TYPE = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])


def label_udf(factory: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]):
    """headline column -> struct<label, score, error>; all of a NULL headline are NULL."""

    @F.pandas_udf(LABEL_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for outs, errors in _answered(batches, factory):
            yield pd.DataFrame({"label": pd.Series([o and o[0] for o in outs], dtype=object),
                                "score": pd.Series([float(o[1]) if o else None for o in outs], dtype="float64"),
                                "error": pd.Series(errors, dtype=object)})

    return run


_MODEL_CACHE: dict = {}


def model_id(factory: Callable) -> str:
    """A name for the model that a factory makes: the same for the same code and captured values."""
    return hashlib.md5(cloudpickle.dumps(factory)).hexdigest()


def cached_model(name: str, factory: Callable):
    """The worker's model of that name; a worker holds one at a time."""
    if name not in _MODEL_CACHE:
        _MODEL_CACHE.clear()
        _MODEL_CACHE[name] = factory()
    return _MODEL_CACHE[name]


def fold_step(name: str, factory: Callable, prompt: str, summary: str) -> tuple[str, str | None]:
    """(summary, error) after one step of a fold: an empty answer leaves the summary as it is."""
    try:
        (out,), (error,) = attempt(cached_model(name, factory), [prompt])
    except Exception as e:  # noqa: BLE001 -- the model can't be made
        return summary, str(e) or type(e).__name__
    return (out or "").strip() or summary, error


def parsed_answers(factory: Callable[[], TextModel], pattern: str) -> Callable[[], TextModel]:
    """The same model, of whose answers only the pattern's first group is kept; an answer without it is empty (a fold passes it over)."""

    def made() -> TextModel:
        model, find = factory(), re.compile(pattern, re.DOTALL | re.IGNORECASE)

        def answer(prompts: list[str]) -> list[str]:
            return [m.group(1).strip() if (m := find.search(a or "")) else "" for a in model(prompts)]

        return answer

    return made


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over the available cores before a model call.

    Prompt rows are small in bytes but expensive per row; AQE would coalesce
    them by bytes into a few tasks. A numbered repartition is not coalesced;
    without keys it is round-robin (balanced, and never elided because of an
    existing hash partitioning). Pass keys only when the next step groups by them.
    The width is ``spark.pricelab.model.partitions`` when set, else the larger of
    the context's default parallelism (all executor cores) and the shuffle width.
    """
    conf = df.sparkSession.conf.get("spark.pricelab.model.partitions", None)
    spark = df.sparkSession
    width = int(conf) if conf else max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(width, *keys) if keys else df.repartition(width)


def generate(df: DataFrame, prompt: str, out: str, factory: Callable[[], TextModel], error: str | None = None) -> DataFrame:
    """``df`` with the model's answer in ``out`` (NULL where it raised), and what it raised in ``error`` if named."""
    df = df.withColumn(f"_{out}_r", text_udf(factory)(F.col(prompt)))
    df = df.withColumn(out, F.col(f"_{out}_r.value"))
    return (df.withColumn(error, F.col(f"_{out}_r.error")) if error else df).drop(f"_{out}_r")


def classify(df: DataFrame, title: str, out: str, factory) -> DataFrame:
    """``df`` with ``out``: struct<label, score, error> of the headline."""
    return df.withColumn(out, label_udf(factory)(F.col(title)))
