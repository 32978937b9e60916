"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

1. language ID: documents whose text has no language go.
2. SimHash near-duplicates: one document of each group stays.
3. benchmark decontamination: documents with a benchmark window go.
4. personal data: spans are replaced by their kind.
5. mixing: what the mix of sources to target weights takes of each document.

All stages but the last return the columns of their input; a stage works on all that its
predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, mixing, pii, simhash
from tidemark.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; trained on the rows of docs that aren't held out."""
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that of the smallest doc_id."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, spans of personal data replaced by their kind in its text."""
    return pii.redact_pii(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document that the mix takes
    words of."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: SQL can't express the learnt and hashed stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
