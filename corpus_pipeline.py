"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Toxic documents go, then exact copies, then near copies but one of each group, then documents are sampled to tempered
source, language and topic weights, and what is left is packed. Stages keep all columns of ``documents``; the last
returns one row per piece of a sequence, with its token identifiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from flowloom.llm.common import read, tuned
from flowloom.llm.queries import vocabulary
from flowloom.session import materialize


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def sample_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their calibrated probabilities."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", keep_civil),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", sample_to_weights),
    ("packing", pack),
]

# A recurrent network and a tokenizer can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
