"""Port snapshots: schedules as operations, delays, facilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions import alerting, port


def schedule_operations(snapshots: DataFrame) -> DataFrame:
    """One row per scheduled arrival or departure; the id is a digest of port, vessel, event and time."""
    rows = snapshots.select("port_code", "port_name", "ts", F.explode("schedules").alias("s"))
    arrival = F.upper("s.event_type") == "ARRIVAL"
    at = F.coalesce("s.actual_time", "s.estimated_time", "s.scheduled_time")
    return rows.select(
        alerting.alert_identity(
            F.col("port_code"), F.col("s.mmsi"), F.col("s.event_type"), F.unix_millis("s.scheduled_time")
        ).alias("operation_id"),
        F.col("port_code").alias("port_id"),
        "port_name",
        F.col("s.mmsi").alias("mmsi"),
        F.col("s.vessel_name").alias("vessel_name"),
        F.upper("s.event_type").alias("operation_type"),
        F.col("s.berth_number").alias("berth_number"),
        F.when(arrival, at).alias("arrival_time"),
        F.when(~arrival, at).alias("departure_time"),
        F.col("s.status").alias("status"),
        F.col("s.scheduled_time").alias("scheduled_time"),
        F.col("s.estimated_time").alias("estimated_time"),
        "ts",
    )


def with_delay(operations: DataFrame) -> DataFrame:
    late = port.delay_minutes(F.col("scheduled_time"), F.col("estimated_time"))
    return operations.withColumns({"delay_minutes": late, "delayed": F.coalesce(late > 0, F.lit(False))})


def with_port_state(snapshots: DataFrame) -> DataFrame:
    """Operational and congestion flags, text and score."""
    status, level = F.col("status"), F.col("congestion_level")
    return snapshots.withColumns(
        {
            "operational": port.is_operational(status),
            "congested": port.is_congested(level),
            "congestion_text": port.congestion_text(level),
            "score": port.port_score(status, level),
        }
    )
