"""Inputs, stored intermediates and batch helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.session import stored_table

__all__ = ["byte_texts", "entry_texts", "file_cleanup", "packed", "row_of", "same_id", "stored_table", "table", "task_number"]

#: Letters, digits and every character outside ASCII; the input is lower-cased before.
WORD = rb"[0-9a-z\x80-\xff]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one of the given tables; only these are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def entry_texts(docs: DataFrame) -> DataFrame:
    """The two columns that most operators need, whatever else the input holds."""
    return docs.select("doc_id", "text")


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts of a batch as UTF-8 bytes, one at a time; null is empty."""
    for value in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield value.as_py() or b""


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def same_id(left: Column, right: Column) -> Column:
    """Equality of ids in which null meets null."""
    return left.eqNullSafe(right)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Every row as one column ``row`` beside the given keys, so that no name of an input column can clash with a key."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in keys.items()])


def row_of(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows. The numbers are stable only once the result is stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def file_cleanup(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of each finished query, which long chains of jobs need."""
    spark.conf.set("spark.sql.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
