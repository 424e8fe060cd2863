"""A training corpus from documents: toxic ones go, near copies go, sources are mixed, texts are encoded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. run() applies them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import byte_bpe, mixing, near_copies, toxicity
from lectern.llm.common import cut, table
from lectern.llm.queries import vocabulary_path, vocabulary_pattern


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; examples are labelled rows of docs."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, 5-word similarity 0.8 or more: the smallest doc_id."""
    return near_copies.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate and its own draw say."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of every row's whole text."""
    return byte_bpe.encode(docs, vocabulary_path(), vocabulary_pattern())


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Votes of nearest examples and merges by rank are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None
