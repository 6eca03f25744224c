"""The corpus pipeline: five stages of the llm operators over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import ngram_join, packing, pii, quality, toxicity
from corvane.llm.common import written
from corvane.llm.queries import table, vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    return toxicity.keep_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep."""
    return quality.keep_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that of the smallest doc_id."""
    return ngram_join.keep_first(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return pii.replace_in_documents(docs, key=pii.session_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("best-fit packing", pack),
]

#: SQL expresses neither the models nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
