"""Alert rules: (metric, operator, threshold) conditions evaluated over positions."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import alerting
from fairlead.operators import skew

# Parts into which the readings of a metric are dealt where the rules are too many to broadcast.
SALTS = 64

# Severity by rule type.
RULE_SEVERITY = {"AIS_LOST": "CRITICAL", "SPEED": "WARNING", "GEOFENCE_ENTRY": "INFO"}
DEFAULT_SEVERITY = "LOW"


class Rule(NamedTuple):
    id: int
    rule_name: str
    rule_type: str
    metric: str
    op: str
    threshold: float
    is_active: bool = True


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """A rule table of rules given in the program."""
    return spark.createDataFrame(
        [tuple(r) for r in rules],
        "id int, rule_name string, rule_type string, metric string, op string, threshold double, is_active boolean",
    )


def _holds() -> Column:
    value, bound = F.col("metric_value"), F.col("threshold")
    return (
        F.when(F.col("op") == ">", value > bound)
        .when(F.col("op") == ">=", value >= bound)
        .when(F.col("op") == "<", value < bound)
        .when(F.col("op") == "<=", value <= bound)
        .when(F.col("op") == "=", value == bound)
    )


def rule_hits(rows: DataFrame, rules: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One row per (position, active rule that holds).

    ``rules`` is a table with the fields of ``Rule``; it is read when the query runs, whatever its size. Every row is
    unpivoted into its readings (metric, value) and these join the rules of their metric: by broadcast while a look at
    the table shows that it is small, else with each metric dealt into ``SALTS`` parts.
    """
    severity = F.coalesce(*[F.when(F.col("rule_type") == t, F.lit(v)) for t, v in RULE_SEVERITY.items()], F.lit(DEFAULT_SEVERITY))
    active = rules.where("is_active").where(F.col("metric").isin(*metrics)).select(
        F.col("metric").alias("_metric"), F.col("id").alias("rule_id"), "rule_name", "rule_type", severity.alias("severity"), "op", "threshold"
    )
    readings = F.array(*[F.struct(F.lit(n).alias("_metric"), c.cast("double").alias("metric_value")) for n, c in metrics.items()])
    read = rows.withColumn("_reading", F.explode(readings)).select("*", "_reading.*").drop("_reading")
    read = read.where(F.col("metric_value").isNotNull())
    if skew.fits_broadcast(active):
        return read.join(F.broadcast(active), (read["_metric"] == active["_metric"]) & _holds()).drop("_metric", "op", "threshold")
    read = read.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = active.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return read.join(copies, ["_metric", "_salt"]).where(_holds()).drop("_metric", "_salt", "op", "threshold")


def rule_alerts(hits: DataFrame) -> DataFrame:
    return hits.select(
        *alerting.alert_row(
            alert_type=F.col("rule_type"),
            severity=F.col("severity"),
            mmsi=F.col("mmsi"),
            vessel_name=F.col("vessel_name"),
            latitude=F.col("latitude"),
            longitude=F.col("longitude"),
            speed=F.col("speed"),
            ts=F.col("ts"),
            seq=F.col("seq"),
            title=F.col("rule_name"),
            description=F.format_string("Rule %s holds with %.2f", F.col("rule_name"), F.col("metric_value")),
            details=alerting.details_map(rule_id=F.col("rule_id"), metric_value=F.col("metric_value")),
            action_required=F.col("severity").isin("WARNING", "CRITICAL"),
            identity=(F.col("rule_id"),),
        )
    )
