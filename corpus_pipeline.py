"""The corpus pipeline: five stages over documents, each an operator of ``folia.llm``.

Each stage works on what its predecessor kept, and its decision takes effect:
documents that the quality classifier rejects go, one document of each
near-duplicate group stays, documents with benchmark passages go, secrets are
cut out of the texts, and the last stage returns the digests of the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.llm.common import cut_table, table
from folia.llm.duck_bpe import token_digests
from folia.llm.near_copies import one_of_each
from folia.llm.ordinal_quality import keep_good, train
from folia.llm.secret_forest import redact
from folia.llm.spaced_decontam import without_overlaps


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("tokens", tokens)]

#: No stage but the decontamination of exact passages has an SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_table(docs)
    return docs
