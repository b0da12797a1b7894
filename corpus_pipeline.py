"""A corpus from raw documents: five stages, each one operator, each written before the next reads it.

A stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialog.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from medialog.llm.common import shared_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go; ``lang`` stays as it is. The model is fitted to labelled rows of ``docs``."""
    return language_id.drop_unknown(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: five words, similarity 0.8."""
    return near_dedup.drop_near_duplicates(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, and the text they stand for."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), and_decode=True)
    return encoded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("text").alias("decoded")
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("exact copies", drop_copies),
    ("near copies", drop_near_copies),
    ("benchmark", drop_leaked),
    ("encode", encode),
]

# Language identification and near duplicates are not for SQL; tests/llm has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a row per document left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
