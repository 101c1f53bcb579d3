"""Parameterised reads: history, search, listings, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import times
from fairlead.operators import sequence

HISTORY_COLUMNS = (
    "mmsi", "vessel_name", "vessel_type", "latitude", "longitude", "speed", "course", "heading", "status", "ts",
    "country", "flag", "call_sign", "imo", "destination", "eta", "draught", "cargo_type",
)
MIN_QUERY_LENGTH = 2


def history_projection(positions: DataFrame) -> DataFrame:
    """The 18 history columns; those a table does not hold come out NULL."""
    return positions.select(
        *[F.col(c) if c in positions.columns else F.lit(None).cast("string").alias(c) for c in HISTORY_COLUMNS]
    )


def vessel_history(history: DataFrame, mmsi: int, start: Column, end: Column) -> DataFrame:
    """Track of one vessel, both ends included, oldest first. A ``ym`` partition column is pruned too."""
    rows = history.where((F.col("mmsi") == mmsi) & F.col("ts").between(start, end))
    if "ym" in history.columns:
        rows = rows.where(F.col("ym").between(times.month_key(start), times.month_key(end)))
    return history_projection(rows).orderBy("ts")


def search_vessels(history: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Vessels whose name contains the text (literally, ignoring case); attributes of the newest fix."""
    found = history.where(F.contains(F.lower("vessel_name"), F.lit(text.lower())))
    if len(text.strip()) < MIN_QUERY_LENGTH:
        found = found.limit(0)
    newest = F.max_by(F.struct("flag", "imo", "call_sign"), F.struct("ts", "seq")).alias("_a")
    return (
        found.groupBy("mmsi", "vessel_name", "vessel_type")
        .agg(newest)
        .select("mmsi", "vessel_name", "vessel_type", "_a.*")
        .orderBy("vessel_name", "mmsi")
        .limit(limit)
    )


def vessel_info(history: DataFrame, mmsi: int) -> DataFrame:
    """One row: the newest attributes and position of a vessel, and when it was last seen."""
    fields = ("vessel_name", "vessel_type", "flag", "imo", "call_sign", "destination", "latitude", "longitude")
    return (
        history.where(F.col("mmsi") == mmsi)
        .groupBy("mmsi")
        .agg(F.max_by(F.struct(*fields), F.struct("ts", "seq")).alias("_a"), F.max("ts").alias("last_seen"))
        .select("mmsi", "_a.*", "last_seen")
    )


def active_vessels(history: DataFrame, since: Column, limit: int = 1000) -> DataFrame:
    """Vessels heard since a time, last heard first."""
    newest = F.max_by(F.struct("flag"), F.struct("ts", "seq")).alias("_a")
    return (
        history.where(F.col("ts") >= since)
        .groupBy("mmsi", "vessel_name", "vessel_type")
        .agg(newest, F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("position_count"))
        .select("mmsi", "vessel_name", "vessel_type", "_a.*", "last_seen", "position_count")
        .orderBy(F.desc("last_seen"), "mmsi")
        .limit(limit)
    )


def vessel_search_with_position(vessels: DataFrame, positions: DataFrame, text: str) -> DataFrame:
    """Master rows whose name contains the text, with the latest position where there is one."""
    found = vessels.where(F.contains(F.lower("vessel_name"), F.lit(text.lower())))
    latest = sequence.latest_per_key(positions.select("mmsi", "latitude", "longitude", "speed", "ts", "seq"), ["mmsi"])
    return found.join(latest, "mmsi", "left")


def port_list(operations: DataFrame) -> DataFrame:
    return (
        operations.groupBy("port_id", "port_name")
        .agg(F.count(F.lit(1)).alias("operation_count"), F.max("ts").alias("last_update"))
        .orderBy("port_name")
    )


def newest_operations(operations: DataFrame, where: Column, limit: int = 10) -> DataFrame:
    """Newest operations of a port or of a vessel."""
    return operations.where(where).orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def operation_by_id(operations: DataFrame, operation_id: str) -> DataFrame:
    return sequence.latest_per_key(operations.where(F.col("operation_id") == operation_id), ["operation_id"])


def weather_by_grid(weather: DataFrame, grid_id: str) -> DataFrame:
    """Newest reading of a grid cell, time as epoch milliseconds."""
    return (
        weather.where(F.col("grid_id") == grid_id)
        .orderBy(F.desc("ts"), F.desc("seq"))
        .limit(1)
        .withColumn("timestamp", F.unix_millis("ts"))
    )


def weather_grids(weather: DataFrame) -> DataFrame:
    return weather.select("grid_id").distinct().orderBy("grid_id")


def newest_alerts(alerts: DataFrame, n: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), F.desc("seq"), "alert_id").limit(n)


def ranked_alerts(alerts: DataFrame) -> DataFrame:
    """Open alerts, the most urgent first, then the newest."""
    open_ones = alerts.where(~F.col("acknowledged") & ~F.col("resolved"))
    return open_ones.orderBy(F.desc("severity_rank"), F.desc("ts"))


def alert_search(alerts: DataFrame, text: str, since: Column) -> DataFrame:
    """Alerts whose type has a word of the text, from a time on."""
    words = F.array(*[F.lit(w) for w in text.lower().split()])
    kinds = F.split(F.lower("alert_type"), "_")
    return alerts.where((F.col("ts") >= since) & F.arrays_overlap(kinds, words))


def auto_resolved(alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Unacknowledged alerts older than the limit count as resolved at their time plus the limit."""
    due = F.unix_millis("ts") + hours * 3_600_000
    lapsed = ~F.col("acknowledged") & ~F.col("resolved") & (due < F.unix_millis(as_of))
    return alerts.withColumns(
        {
            "resolved_at": F.when(lapsed, F.timestamp_millis(due)),
            "resolved": F.col("resolved") | lapsed,
        }
    )


def name_match(vessels: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Vessels sharing a word with the text, most shared words first."""
    words = F.array_distinct(F.split(F.lower("vessel_name"), " "))
    wanted = F.array(*[F.lit(w) for w in dict.fromkeys(text.lower().split())])
    return (
        vessels.withColumn("score", F.size(F.array_intersect(words, wanted)))
        .where(F.col("score") > 0)
        .orderBy(F.desc("score"), "vessel_name", "mmsi")
        .limit(limit)
    )


def name_autocomplete(vessels: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    return (
        vessels.where(F.startswith(F.lower("vessel_name"), F.lit(prefix.lower())))
        .select("mmsi", "vessel_name")
        .orderBy("vessel_name", "mmsi")
        .limit(limit)
    )


def type_tabs(latest: DataFrame, category: Column) -> DataFrame:
    """Vessels per display category, with the grand total as ``all``."""
    return (
        latest.withColumn("tab", F.explode(F.array(F.lit("all"), category)))
        .groupBy("tab")
        .agg(F.count(F.lit(1)).alias("vessels"))
    )


def without_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """First row per key among those whose key is not known yet."""
    return rows.dropDuplicates([key]).join(known.select(key), key, "left_anti")


