"""Enrichment of positions: movement since the previous fix, and vessel master data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions import geo, vessel
from fairlead.operators import sequence, skew

PREVIOUS_FIELDS = ("latitude", "longitude", "speed", "course", "ts")

# What a vessel without master data gets.
DEFAULT_FLAG = "ID"
DEFAULT_DESTINATION = "Unknown"

MASTER_COLUMNS = ("imo_number", "callsign", "vessel_type", "flag_state", "length", "width", "eta", "draught")


def with_movement(positions: DataFrame, seconds: float = sequence.SLICE_SECONDS) -> DataFrame:
    """``prev`` struct, distance in nm and elapsed ms from the previous fix; all NULL on the first fix."""
    rows = sequence.with_previous(positions, PREVIOUS_FIELDS, seconds=seconds)
    return rows.withColumns(
        {
            "distance_from_previous": geo.distance_nm(
                F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude")
            ),
            "time_since_last_update": F.unix_millis("ts") - F.unix_millis("prev.ts"),
        }
    )


def with_inferred_type(positions: DataFrame) -> DataFrame:
    return positions.withColumn("vessel_type", vessel.type_from_name(F.col("vessel_name")))


def enriched(positions: DataFrame, seconds: float = sequence.SLICE_SECONDS) -> DataFrame:
    """Enriched position rows without master data: type by name, default flag and destination."""
    return with_inferred_type(with_movement(positions, seconds)).withColumns(
        {
            "flag": F.lit(DEFAULT_FLAG),
            "destination": F.lit(DEFAULT_DESTINATION),
            "grid_cell": geo.position_cell(F.col("latitude"), F.col("longitude")),
            "validated": F.lit(True),
            "validation_status": F.lit("VALID"),
        }
    )


def with_master(positions: DataFrame, vessels: DataFrame) -> DataFrame:
    """Left join to the vessel master on mmsi, with the fallbacks for unknown vessels.

    Works on a streaming position table too (stream-static join).
    """
    master = vessels.select("mmsi", *[F.col(c).alias(f"_m_{c}") for c in MASTER_COLUMNS])
    joined = skew.join_dimension(positions, master, ["mmsi"], spread=[F.col("ts"), F.col("seq")])
    return joined.withColumns(
        {
            "vessel_type": F.coalesce("_m_vessel_type", vessel.type_from_name(F.col("vessel_name"))),
            "flag": F.coalesce("_m_flag_state", F.lit(DEFAULT_FLAG)),
            "imo": F.coalesce("imo", "_m_imo_number"),
            "call_sign": F.coalesce("call_sign", "_m_callsign"),
            "destination": F.coalesce("destination", F.lit(DEFAULT_DESTINATION)),
            "length": F.col("_m_length"),
            "width": F.col("_m_width"),
            "eta": F.col("_m_eta"),
            "draught": F.col("_m_draught"),
            "known_vessel": F.col("_m_flag_state").isNotNull(),
        }
    ).drop(*[f"_m_{c}" for c in MASTER_COLUMNS])
