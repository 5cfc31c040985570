"""The corpus pipeline: from raw documents to packed training sequences.

1. language_id: documents without a letter, or in no language the model knows, go.
2. ngram_jaccard: one document of each group of near copies stays.
3. secret_scan: secrets are replaced in the texts that stay.
4. best_fit_packing: the texts are tokenised and packed into sequences.

Each stage sees all its predecessor kept. All but the last return the columns of
documents; the last one returns a row per piece (doc_id, piece, start, length,
ids_crc32, sequence_id, offset). SQL cannot express the stages: ORACLE_SQL is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from odolake.llm import language_id, lp_packing, ngram_join, secret_scan
from odolake.llm.common import small_batches
from odolake.operators.keep import keep


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id.keep_known(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.deduplicate(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lp_packing.pack(lp_packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_languages),
    ("ngram_jaccard", without_near_copies),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
