"""Quality classifier, quality rules, near-dedup, decontamination and tokenisation of the documents table.

Each stage takes what the one before it kept, written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, quality_classifier, quality_rules, sentence_pieces, simhash
from textloom.llm.common import table, written


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labels of this input, rejects."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie beyond their group's fences."""
    return quality_rules.keep_good(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate group, over shingles of five words."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what remains."""
    return sentence_pieces.encode(docs)


STAGES = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("simhash_near_dedup", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece", tokenised),
]
#: SQL expresses neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
