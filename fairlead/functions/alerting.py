"""The common alert row: severities, identity, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from the least to the most urgent.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")

ALERT_COLUMNS = (
    "alert_id",
    "alert_type",
    "severity",
    "severity_rank",
    "mmsi",
    "vessel_name",
    "involved_mmsis",
    "latitude",
    "longitude",
    "speed",
    "title",
    "description",
    "details",
    "detected_at",
    "ts",
    "seq",
    "action_required",
    "acknowledged",
    "resolved",
)


def severity_rank(severity: Column) -> Column:
    """1 for INFO up to 5 for CRITICAL, 0 for anything else."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def alert_identity(*parts: Column) -> Column:
    """A replay of the same input gives the same id."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def details_map(**values: Column) -> Column:
    """map<string, string>; missing values stay NULL."""
    entries = []
    for name, value in values.items():
        entries += [F.lit(name), value.cast("string")]
    return F.create_map(*entries)


def alert_row(
    *,
    alert_type: Column,
    severity: Column,
    mmsi: Column,
    ts: Column,
    seq: Column,
    title: Column,
    description: Column,
    details: Column,
    action_required: Column,
    vessel_name: Column | None = None,
    involved: Column | None = None,
    latitude: Column | None = None,
    longitude: Column | None = None,
    speed: Column | None = None,
    identity: tuple[Column, ...] = (),
) -> list[Column]:
    """The select list that every detector ends with."""
    none_double = F.lit(None).cast("double")
    return [
        alert_identity(alert_type, mmsi, F.unix_micros(ts), seq, *identity).alias("alert_id"),
        alert_type.alias("alert_type"),
        severity.alias("severity"),
        severity_rank(severity).alias("severity_rank"),
        mmsi.alias("mmsi"),
        (vessel_name if vessel_name is not None else F.lit(None).cast("string")).alias("vessel_name"),
        (involved if involved is not None else F.array(mmsi)).alias("involved_mmsis"),
        (latitude if latitude is not None else none_double).alias("latitude"),
        (longitude if longitude is not None else none_double).alias("longitude"),
        (speed if speed is not None else none_double).alias("speed"),
        title.alias("title"),
        description.alias("description"),
        details.alias("details"),
        ts.alias("detected_at"),
        ts.alias("ts"),
        seq.alias("seq"),
        action_required.alias("action_required"),
        F.lit(False).alias("acknowledged"),
        F.lit(False).alias("resolved"),
    ]
