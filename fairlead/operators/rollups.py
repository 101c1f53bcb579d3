"""Rollups kept as mergeable states: counts, sums, minima and maxima; averages are derived at the end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import times


@dataclass(frozen=True)
class Rollup:
    """Group keys, a time window and the measures held per group.

    ``averages``, ``minima``, ``maxima`` and ``variances`` (of the sample) map an output name to its source column. The window is a real event
    time window, so that on a stream the state of a group can be dropped once the watermark has passed it.
    """

    keys: tuple[str, ...]
    window: tuple[str, str]
    averages: dict[str, str] = field(default_factory=dict)
    minima: dict[str, str] = field(default_factory=dict)
    maxima: dict[str, str] = field(default_factory=dict)
    variances: dict[str, str] = field(default_factory=dict)
    count: str = "n"

    @property
    def groups(self) -> tuple[str, ...]:
        return (*self.keys, self.window[0])

    def state(self, rows: DataFrame) -> DataFrame:
        """Mergeable state of the rows; works on a streaming table as well."""
        measures = [F.count(F.lit(1)).alias(self.count)]
        for name, source in self.averages.items():
            measures += [F.sum(source).alias(f"{name}__sum"), F.count(source).alias(f"{name}__n")]
        for name, source in self.variances.items():
            measures += [F.sum(source).alias(f"{name}__sum"), F.sum(F.col(source) * F.col(source)).alias(f"{name}__squares"), F.count(source).alias(f"{name}__n")]
        measures += [F.min(source).alias(name) for name, source in self.minima.items()]
        measures += [F.max(source).alias(name) for name, source in self.maxima.items()]
        name, width = self.window
        grouped = rows.groupBy(*self.keys, F.window("ts", width).alias("_w")).agg(*measures)
        return grouped.withColumn(name, F.col("_w.start")).drop("_w")

    def merged(self, states: Sequence[DataFrame]) -> DataFrame:
        """State of the union of what the states cover."""
        both = reduce(DataFrame.unionByName, states)
        measures = [F.sum(self.count).alias(self.count)]
        for name in self.averages:
            measures += [F.sum(f"{name}__{p}").alias(f"{name}__{p}") for p in ("sum", "n")]
        for name in self.variances:
            measures += [F.sum(f"{name}__{p}").alias(f"{name}__{p}") for p in ("sum", "squares", "n")]
        measures += [F.min(name).alias(name) for name in self.minima]
        measures += [F.max(name).alias(name) for name in self.maxima]
        return both.groupBy(*self.groups).agg(*measures)

    def finished(self, state: DataFrame) -> DataFrame:
        averages = [F.try_divide(F.col(f"{n}__sum"), F.col(f"{n}__n")).alias(n) for n in self.averages]
        variances = []
        for n in self.variances:
            total, squares, rows = (F.col(f"{n}__{p}") for p in ("sum", "squares", "n"))
            variances.append(F.when(rows > 1, F.greatest(F.lit(0.0), (squares - total * total / rows) / (rows - 1))).alias(n))
        return state.select(*self.groups, self.count, *averages, *self.minima, *self.maxima, *variances)


MOVEMENT_HOURLY = Rollup(
    keys=("mmsi", "vessel_name", "vessel_type"),
    window=("hour", "1 hour"),
    count="position_count",
    averages={"avg_speed": "speed", "avg_latitude": "latitude", "avg_longitude": "longitude"},
    maxima={"max_speed": "speed"},
    minima={"min_speed": "speed"},
)
WEATHER_HOURLY = Rollup(
    keys=("grid_id",),
    window=("hour", "1 hour"),
    count="reading_count",
    averages={
        f"avg_{m}": m for m in ("temperature", "wind_speed", "wave_height", "visibility", "pressure", "humidity")
    },
)
POSITIONS_PER_MINUTE = Rollup(
    keys=("mmsi",),
    window=("minute", "1 minute"),
    count="message_count",
    averages={"avg_latitude": "latitude", "avg_longitude": "longitude", "avg_speed": "speed"},
    maxima={"max_speed": "speed"},
    minima={"min_speed": "speed"},
)


#: What the check for erratic speeds looks at.
SPEED_WINDOWS = Rollup(
    keys=("mmsi",),
    window=("window_start", "5 minutes"),
    maxima={"max_speed": "speed", "vessel_type": "vessel_type"},
    variances={"speed_variance": "speed"},
)


def alerts_daily(alerts: DataFrame, exact: bool = True) -> DataFrame:
    """Alerts and affected vessels per type, severity and day; ``exact=False`` counts vessels by a sketch."""
    vessels = F.count_distinct("mmsi") if exact else F.approx_count_distinct("mmsi")
    return alerts.groupBy("alert_type", "severity", times.day_text(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("alert_count"), vessels.alias("affected_vessels")
    )


def alerts_daily_sketch(alerts: DataFrame) -> DataFrame:
    """Mergeable form: a sketch of the vessels instead of their number."""
    return alerts.groupBy("alert_type", "severity", times.day_text(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("alert_count"), F.hll_sketch_agg("mmsi").alias("vessel_sketch")
    )


def merge_alert_sketches(states: Sequence[DataFrame]) -> DataFrame:
    both = reduce(DataFrame.unionByName, states)
    return both.groupBy("alert_type", "severity", "day").agg(
        F.sum("alert_count").alias("alert_count"), F.hll_union_agg("vessel_sketch").alias("vessel_sketch")
    )


def _operation_counts() -> list[Column]:
    kind = F.col("operation_type")
    return [
        F.count_distinct("mmsi").alias("unique_vessels"),
        F.count_if(kind == "ARRIVAL").alias("arrivals"),
        F.count_if(kind == "DEPARTURE").alias("departures"),
    ]


def port_traffic_daily(operations: DataFrame) -> DataFrame:
    return operations.groupBy("port_id", "port_name", times.day_text(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("operation_count"),
        *_operation_counts(),
        F.count_if(F.col("status") == "COMPLETED").alias("completed_operations"),
    )


def port_stats(operations: DataFrame, port_id: str | None = None) -> DataFrame:
    """Totals of one port, or of every port."""
    rows = operations if port_id is None else operations.where(F.col("port_id") == port_id)
    return rows.groupBy("port_id", "port_name").agg(
        F.count(F.lit(1)).alias("total_operations"),
        *_operation_counts(),
        F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.max("ts").alias("last_update"),
    )


def port_analytics(operations: DataFrame, since: Column) -> DataFrame:
    return operations.where(F.col("ts") >= since).groupBy("port_id").agg(*_operation_counts())


def active_alerts_summary(alerts: DataFrame, by_rank: bool = False) -> DataFrame:
    """Unresolved alerts per type and severity; severities sort as text, or by urgency with ``by_rank``."""
    summary = (
        alerts.where(~F.col("resolved"))
        .groupBy("alert_type", "severity", "severity_rank")
        .agg(
            F.count(F.lit(1)).alias("alert_count"),
            F.min("ts").alias("oldest_alert"),
            F.max("ts").alias("latest_alert"),
        )
    )
    return summary.orderBy(F.desc("severity_rank" if by_rank else "severity"), F.desc("alert_count"))


def fleet_status(current: DataFrame) -> DataFrame:
    return current.agg(
        F.count(F.lit(1)).alias("total_vessels"),
        F.count_if(F.col("speed") > 0).alias("moving_vessels"),
        F.count_if(F.col("speed") == 0).alias("stationary_vessels"),
        F.avg("speed").alias("avg_speed"),
        F.max("ts").alias("last_update"),
    )


def vessel_daily(positions: DataFrame) -> DataFrame:
    return positions.groupBy("mmsi", times.day_text(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("position_count"),
        F.avg("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"),
        F.count_distinct(F.struct("latitude", "longitude")).alias("unique_positions"),
    )


def vessel_year_daily(positions: DataFrame, mmsi: int, as_of: Column) -> DataFrame:
    """Per-day statistics of one vessel over the year before ``as_of``."""
    return vessel_daily(
        positions.where((F.col("mmsi") == mmsi) & (F.col("ts") >= F.add_months(as_of, -12)))
    )


def traffic_by_region(positions: DataFrame, region: Column) -> DataFrame:
    return (
        positions.withColumn("region", region)
        .where(F.col("region").isNotNull())
        .groupBy(times.hour_start(F.col("ts")).alias("hour"), "region")
        .agg(
            F.count_distinct("mmsi").alias("vessel_count"),
            F.count(F.lit(1)).alias("message_count"),
            F.avg("speed").alias("avg_speed"),
            F.array_join(F.array_sort(F.collect_set("vessel_type")), ",").alias("vessel_types"),
        )
    )


def traffic_daily(positions: DataFrame, start: Column, end: Column) -> DataFrame:
    return (
        positions.where(F.col("ts").between(start, end))
        .groupBy(times.day_text(F.col("ts")).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.count_distinct("mmsi").alias("vessels"),
            F.avg("speed").alias("avg_speed"),
        )
    )


def density_grid(positions: DataFrame, since: Column, more_than: int = 5) -> DataFrame:
    """Distinct vessels per tenth-degree cell (rounded down), cells above the limit, busiest first."""
    return (
        positions.where(F.col("ts") >= since)
        .groupBy(
            (F.floor(F.col("latitude") * 10) / 10).alias("lat_grid"),
            (F.floor(F.col("longitude") * 10) / 10).alias("lon_grid"),
        )
        .agg(F.count_distinct("mmsi").alias("vessel_count"))
        .where(F.col("vessel_count") > more_than)
        .orderBy(F.desc("vessel_count"))
    )


def type_distribution(positions: DataFrame, since: Column) -> DataFrame:
    return (
        positions.where(F.col("ts") >= since)
        .groupBy("vessel_type")
        .agg(F.count_distinct("mmsi").alias("vessel_count"))
        .orderBy(F.desc("vessel_count"))
    )


def alert_stats_by_type(alerts: DataFrame, since: Column) -> DataFrame:
    return (
        alerts.where(F.col("ts") >= since)
        .groupBy("alert_type")
        .agg(
            F.count(F.lit(1)).alias("alert_count"),
            F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        )
    )


IN_PORT_CODES = (1, 5)


def live_stats(positions: DataFrame, alerts: DataFrame, as_of: Column, active_minutes: int = 60) -> DataFrame:
    """One row of counters: all vessels, by their latest fix those in port, under way and active, and open alerts."""
    per_vessel = positions.groupBy("mmsi").agg(
        F.max_by("navigation_status", F.struct("ts", "seq")).alias("code"),
        F.max("ts").alias("seen"),
        F.count_if(F.unix_millis(as_of) - F.unix_millis("ts") < 3_600_000).alias("last_hour"),
    )
    code = F.col("code")
    age = F.unix_millis(as_of) - F.unix_millis("seen")
    return per_vessel.agg(
        F.count(F.lit(1)).alias("total_vessels"),
        F.count_if(code.isin(*IN_PORT_CODES)).alias("in_port"),
        F.count_if(~code.isin(*IN_PORT_CODES)).alias("under_way"),
        F.count_if(age <= active_minutes * 60_000).alias("active_vessels"),
        F.sum("last_hour").alias("positions_last_hour"),
        F.any_value(alerts.where("NOT acknowledged").agg(F.count(F.lit(1))).scalar()).alias("active_alerts"),
    )


def period_change(positions: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Vessels per state in the last period and in the one before, with the relative change in percent."""
    length = hours * 3_600_000
    age = F.unix_millis(as_of) - F.unix_millis("ts")
    states = F.array(
        F.lit("active"), F.when(F.col("navigation_status").isin(*IN_PORT_CODES), "in_port").otherwise("at_sea")
    )
    counted = (
        positions.where(age < 2 * length)
        .withColumn("period", F.when(age < length, "now").otherwise("before"))
        .withColumn("state", F.explode(states))
        .groupBy("state")
        .agg(
            F.count_distinct(F.when(F.col("period") == "now", F.col("mmsi"))).alias("vessels_now"),
            F.count_distinct(F.when(F.col("period") == "before", F.col("mmsi"))).alias("vessels_before"),
        )
    )
    change = F.try_divide(
        (F.col("vessels_now") - F.col("vessels_before")) * F.lit(100.0), F.col("vessels_before").cast("double")
    )
    return counted.withColumn("change_pct", change)
