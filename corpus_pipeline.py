"""A corpus pipeline of five stages: toxicity, exact and near duplicates, mixing to target weights, BPE encoding.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the columns
of ``documents``. Rows with nulls pass through the stages as the operators define it; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlead.llm import bpe, exact_dedup, mixing, simhash, toxicity
from fairlead.llm.common import file_cleanup, stored_table, table
from fairlead.llm.queries import older_half, rank_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go."""
    file_cleanup(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    file_cleanup(spark)
    return exact_dedup.without_duplicates(docs, older_half())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one with the smallest id stays."""
    file_cleanup(spark)
    return simhash.without_near_duplicates(docs, words=4, distance=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    file_cleanup(spark)
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, one row per copy, with the digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, *rank_file(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]

#: Learned scores, fingerprints and token ids are out of reach for SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
