"""A corpus in five stages: language, exact copies, near copies, mixing of sources, BPE tokens.

Each stage reads what the one before it kept, as Parquet. A stage's parameters are its operator's defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from shardloom.llm.common import cut, table
from shardloom.llm.queries import vocabulary


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id.accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z's case) the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, digest of the decoded text."""
    return bpe.encode_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", languages), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies), ("source_mixing", mixed), ("bpe", tokens)]

#: A network's predictions, the mix and BPE aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
