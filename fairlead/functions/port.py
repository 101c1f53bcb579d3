"""Scalar rules on port state and port schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_operational(status: Column) -> Column:
    return F.coalesce(F.upper(status) == "OPERATIONAL", F.lit(False))


def is_congested(level: Column) -> Column:
    return F.coalesce(level > 70, F.lit(False))


def congestion_text(level: Column) -> Column:
    return (
        F.when(level.isNull(), F.lit("Unknown"))
        .when(level < 30, F.lit("Low"))
        .when(level < 70, F.lit("Moderate"))
        .otherwise(F.lit("High"))
    )


def port_score(status: Column, level: Column) -> Column:
    return F.when(is_operational(status), 100).otherwise(50) - F.when(is_congested(level), 20).otherwise(0)


def has_facility(facilities: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(facilities, name), F.lit(False))


def delay_minutes(scheduled: Column, estimated: Column) -> Column:
    """Whole minutes between the scheduled and the estimated time; negative when early."""
    return F.floor((F.unix_millis(estimated) - F.unix_millis(scheduled)) / 60000)
