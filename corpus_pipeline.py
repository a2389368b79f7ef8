"""A training-corpus pipeline: language, copies, near copies, mixture, tokens.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir) and returns the documents that go on, with
their columns as they came; the last one adds the tokens. ``run`` applies them to the table ``documents``, each
stage's result written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.llm import bpe, exactdedup, langid, mixing, neardup
from pricelab.llm.common import fresh, stored, table
from pricelab.session import prepare_session

#: A document goes if it has no letters or if its language is less likely than this.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    prepare_session(spark)
    found = fresh("l")
    got = langid.identify(docs, out=found)
    return got.where((F.col(found + ".lang") != langid.UND) & (F.col(found + ".score") >= LEAST_SCORE)).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    prepare_session(spark)
    return exactdedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8), the one with the smallest doc_id."""
    prepare_session(spark)
    return neardup.one_of_each(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    prepare_session(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (binary, little-endian unsigned 32-bit) and how many they are."""
    prepare_session(spark)
    ids, n = "token_ids", "n_tokens"
    taken = {c.lower() for c in docs.columns}
    ids, n = (fresh(c) if c in taken else c for c in (ids, n))
    return bpe.encode(docs, ids=ids).withColumn(n, F.expr(f"cast(octet_length({ids}) div 4 as long)"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("tokens", tokens)]
#: Language models and tokens are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
