"""Shared inputs and output helpers of the query library."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators import detect, enrich, sequence, throttle, validate
from fairlead.plans import lenses

def newest(rows: DataFrame) -> Column:
    """Largest event time of a table, as a scalar subquery."""
    return rows.agg(F.max("ts")).scalar()


def as_of(spark: SparkSession, sf: str) -> Column:
    return newest(lenses.positions(spark, sf))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.with_inferred_type(valid_rows(lenses.positions(spark, sf)))


def valid_long(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.with_inferred_type(valid_rows(lenses.positions_long(spark, sf)))


@lru_cache(maxsize=64)
def _slice_of(app: str, sf: str) -> float:
    spark = SparkSession.active()
    return sequence.slice_seconds(lenses.positions(spark, sf).select("mmsi", "ts"))


def slice_of(spark: SparkSession, sf: str) -> float:
    """Slice length that fits the busiest vessel of the dense lens; looked up once per data set."""
    return _slice_of(spark.sparkContext.applicationId, sf)


def valid_rows(rows: DataFrame) -> DataFrame:
    # The age rules have their own entry; here they would only add a pass for "now".
    reason = validate.position_reject_reason(F.lit(None).cast("timestamp"), check_age=False)
    return rows.where(reason.isNull())


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enriched(valid(spark, sf), slice_of(spark, sf))


def moved(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.with_movement(valid(spark, sf), slice_of(spark, sf))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The throttled speed alerts of the dense lens."""
    passed = throttle.throttled(detect.first_check(enriched(spark, sf)), seconds=slice_of(spark, sf))
    return detect.speed_alert_rows(passed)


def millis(*names: str) -> list[Column]:
    return [F.unix_millis(n).alias(f"{n}_ms") for n in names]


# Engines round exact halves differently; results are moved off them before rounding.
NUDGE = 1e-9


def near(value: Column, digits: int = 6) -> Column:
    return F.round(value + NUDGE, digits)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [near(F.col(n), digits).alias(n) for n in names]
