"""Cleaning of a corpus in stages: language, near-duplicates, secrets, packing into training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.llm import language, minhash, packing, secrets
from fareloom.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Rejected: no letter at all, or no family of languages is likely.

    A script that no labelled row has is not recognised. Without any labelled row to learn from, every document with a
    letter stays. All columns keep their values, whatever their names.
    """
    machines = language.fit(docs, remainder=-1)
    if machines is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    own = {c.lower() for c in docs.columns}
    added = tuple(next(n for n in (name + "_" * i for i in range(len(own) + 1)) if n not in own) for name in ("lang_pred", "score"))
    found = language.identify(docs, machines, added)
    sure = (F.col(added[0]) != language.UNKNOWN) & (F.col(added[1]) >= language.MIN_SCORE)
    return found.where(sure).drop(*added)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.near_dedup(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; `n_chars` follows the new text."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_dedup", without_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Linear machines and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
