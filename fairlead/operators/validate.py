"""Validity rules. Each gives the name of the first failing rule, or NULL for a good row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the position rules.
MAX_SPEED_KN = 102.3
FUTURE_TOLERANCE_MS = 60_000
MAX_AGE_MS = 3_600_000
MIN_QUALITY = 50


def coordinates_ok(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def position_reject_reason(
    as_of: Column, *, check_age: bool = True, strict_mmsi: bool = False
) -> Column:
    """First failing rule of mmsi, coordinates, speed, timestamp, future, age."""
    mmsi, ts = F.col("mmsi"), F.col("ts")
    mmsi_ok = mmsi.between(100_000_000, 999_999_999) if strict_mmsi else mmsi > 0
    reason = (
        F.when(~F.coalesce(mmsi_ok, F.lit(False)), "INVALID_MMSI")
        .when(~coordinates_ok(F.col("latitude"), F.col("longitude")), "INVALID_COORDINATES")
        .when(~F.coalesce(F.col("speed").between(0, MAX_SPEED_KN), F.lit(False)), "INVALID_SPEED")
        .when(ts.isNull(), "MISSING_TIMESTAMP")
    )
    if check_age:
        age = F.unix_millis(as_of) - F.unix_millis(ts)
        reason = reason.when(age < -FUTURE_TOLERANCE_MS, "FUTURE_TIMESTAMP").when(
            age > MAX_AGE_MS, "OLD_TIMESTAMP"
        )
    return reason


def with_reject_reason(positions: DataFrame, as_of: Column, **rules) -> DataFrame:
    return positions.withColumn("reject_reason", position_reject_reason(as_of, **rules))


def split_rejects(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): both read the same tagged rows; together they are the input."""
    good = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, tagged.where(F.col("reject_reason").isNotNull())


def ingest_ok() -> Column:
    """Ingest-time validity of a position: no speed and no age rule."""
    return F.coalesce(F.col("mmsi") > 0, F.lit(False)) & located_ok()


def located_ok() -> Column:
    """Validity of a weather row: coordinates in range and a time."""
    return coordinates_ok(F.col("latitude"), F.col("longitude")) & F.col("ts").isNotNull()


def port_ok() -> Column:
    return F.coalesce(F.trim("port_code") != "", F.lit(False)) & located_ok()


def numeric_coordinates(rows: DataFrame) -> DataFrame:
    """Keep rows whose coordinates can be read as numbers; the columns become doubles."""
    typed = rows.withColumns(
        {c: F.col(c).cast("string").try_cast("double") for c in ("latitude", "longitude")}
    )
    return typed.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def fill_envelope(rows: DataFrame, as_of: Column, collector_id: str, data_type: str) -> DataFrame:
    """Fill missing envelope fields; the id is a digest of the payload, so a replay gives the same id."""
    return rows.withColumns(
        {
            "id": F.coalesce("id", F.sha2(F.concat_ws("|", F.lit(collector_id), "rawData"), 256)),
            "timestamp": F.coalesce("timestamp", as_of),
            "collectorId": F.coalesce("collectorId", F.lit(collector_id)),
            "dataType": F.coalesce("dataType", F.lit(data_type)),
        }
    )


def payload_present() -> Column:
    return F.coalesce(F.trim("rawData") != "", F.lit(False))
