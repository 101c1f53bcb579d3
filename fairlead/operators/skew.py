"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
SALTS = 256
BROADCAST_ROWS = 100_000


def fits_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Look at no more than ``max_rows + 1`` rows to learn whether a side may be broadcast."""
    return dim.limit(max_rows + 1).count() <= max_rows


def heaviest_keys(rows: DataFrame, keys: Sequence[str], top: int = HOT_KEYS) -> DataFrame:
    """The keys that hold at least one row in ``top`` of all rows; by that there are no more than ``top`` of them."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n")).scalar()
    return counted.where(F.col("_n") * top >= total).select(*keys, F.lit(True).alias("_hot"))


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Sequence[Column],
    how: str = "left",
    salts: int = SALTS,
    top: int = HOT_KEYS,
) -> DataFrame:
    """Equi-join in which the heaviest keys are spread over ``salts`` tasks.

    Only rows of keys that hold one row in ``top`` or more get a salt on the fact side; only their dimension rows
    are repeated, ``salts`` times. ``spread`` are fact columns that vary inside a key.
    """
    keys = list(keys)
    hot = F.broadcast(heaviest_keys(fact, keys, top))
    # Rows without a key meet nothing, so they may go anywhere.
    nowhere = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.when(F.col("_hot") | nowhere, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = fact.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = dim.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Sequence[Column],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join to master data: broadcast when its checked size allows, salted otherwise.

    A streaming fact side takes an ordinary stream-static join beyond the bound, because the heaviest keys
    of a stream cannot be counted up front.
    """
    if fits_broadcast(dim, max_rows):
        return fact.join(F.broadcast(dim), list(keys), how)
    if fact.isStreaming:
        return fact.join(dim, list(keys), how)
    return salted_join(fact, dim, keys, spread, how)
