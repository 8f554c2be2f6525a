"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import language, mixing, simhash, surrogates, wumanber
from weftline.llm.common import stored, table

#: Documents whose language is told with less than this are rejected, beside those without any letter.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents whose language can't be told go; a missing lang is filled in."""
    return language.keep_identified(docs, least=LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of near copies (five-word fingerprints, Jaccard similarity 0.8) the smallest id stays.

    Rows without id stay only where no other of their group does; texts without words are copies of each other.
    """
    return simhash.keep_first(docs, max_bits=11, words=5, percent=80, seed=42)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a window of a benchmark item go."""
    return wumanber.keep_clean(docs, table(spark, sf_dir, "benchmark"), size=10)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: personal data is replaced in the texts; n_chars follows them."""
    return surrogates.replace_entities(docs).selectExpr(
        *[c if c != "n_chars" else "CAST(length(text) AS BIGINT) AS n_chars" for c in docs.columns]
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the training mixture, a row for each epoch that uses a document."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]

#: Language models, fingerprints and keyed surrogates are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
