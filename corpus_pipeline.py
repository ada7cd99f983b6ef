"""The corpus pipeline: five stages, each a function of (spark, docs, sf_dir); all but the last keep documents' columns.

SQL cannot express the learned stages, so ``ORACLE_SQL`` is None and the tests hold the run against plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeweft.llm import mixing, ngram_join, packing, quality, secret_scan
from citeweft.llm.common import durable, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go.

    Null and empty texts have no words and go; a null doc_id is judged by its text; repeated rows each stay or go;
    further columns are dropped; an empty table gives no rows.
    """
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Texts without words are in no group and stay; so do rows without a doc_id. Of rows that repeat a doc_id those with
    different texts stay, equal ones count as one; an empty table gives no rows.
    """
    return ngram_join.one_of_each_group(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every row stays, repeated ones and null texts as they are."""
    return secret_scan.redacted_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with as much of their text, as the mix takes them.

    Texts without words give nothing; a null source is a source of its own, last in order; repeated rows are documents
    of their own; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences, a row for each piece of a document; null texts are the end id alone, no rows give none."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard", one_of_each_group),
    ("secret_scan", without_secrets),
    ("mix_sources", mixed),
    ("pack_sequences", packed),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
