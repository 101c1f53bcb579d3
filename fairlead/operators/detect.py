"""Detectors: functions from positions to rows of the common alert schema.

A detector is any ``Callable[[DataFrame], DataFrame]`` that ends in :func:`alerting.alert_row`; a list of them
is run by :func:`run_detectors`. New alert types are added by writing one more such function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import alerting, geo, vessel
from fairlead.operators import sequence

# Thresholds of the coded detectors.
SPEED_FACTOR = 1.5
STOP_FROM_KN = 10.0
STOP_BELOW_KN = 1.0
MAX_ACCELERATION_KN_S = 1.0

Detector = Callable[[DataFrame], DataFrame]

EXCESSIVE, STOP, ACCELERATION = "EXCESSIVE_SPEED", "SUDDEN_STOP", "IMPOSSIBLE_ACCELERATION"

# Severity and action flag by alert type, in the order in which the checks run.
SPEED_CHECKS = {EXCESSIVE: ("HIGH", True), STOP: ("MEDIUM", False), ACCELERATION: ("LOW", False)}


def run_detectors(positions: DataFrame, detectors: Iterable[Detector]) -> DataFrame:
    """Union of the alert rows of several detectors."""
    return reduce(DataFrame.unionByName, [d(positions) for d in detectors])


def has_previous() -> Column:
    return F.col("speed").isNotNull() & F.col("prev.speed").isNotNull()


def excessive_speed() -> Column:
    return has_previous() & (F.col("speed") > vessel.top_speed(F.col("vessel_type")) * SPEED_FACTOR)


def sudden_stop() -> Column:
    return has_previous() & (F.col("prev.speed") > STOP_FROM_KN) & (F.col("speed") < STOP_BELOW_KN)


def acceleration() -> Column:
    """Knots per second since the previous fix; NULL without a time step."""
    return F.try_divide(F.abs(F.col("speed") - F.col("prev.speed")), F.col("time_since_last_update") / 1000.0)


def impossible_acceleration() -> Column:
    return has_previous() & F.coalesce(acceleration() > MAX_ACCELERATION_KN_S, F.lit(False))


def with_speed_checks(enriched: DataFrame) -> DataFrame:
    """``checks`` = array of the alert types that a row meets, in check order."""
    met = F.array(
        F.when(excessive_speed(), F.lit(EXCESSIVE)),
        F.when(sudden_stop(), F.lit(STOP)),
        F.when(impossible_acceleration(), F.lit(ACCELERATION)),
    )
    return enriched.withColumn("checks", F.filter(met, lambda c: c.isNotNull()))


def speed_candidates(enriched: DataFrame) -> DataFrame:
    """One row per (position, met check), before throttling; ``check_order`` is 0, 1, 2."""
    rows = with_speed_checks(enriched).where(F.size("checks") > 0)
    return rows.select("*", F.posexplode("checks").alias("check_order", "alert_type")).drop("checks")


def first_check(enriched: DataFrame) -> DataFrame:
    """One row per position that meets any check: the first in check order, which is all the throttle can pass."""
    rows = with_speed_checks(enriched).where(F.size("checks") > 0)
    return rows.withColumn("alert_type", F.get("checks", F.lit(0))).drop("checks")


def speed_alert_rows(candidates: DataFrame) -> DataFrame:
    """Common alert rows of speed candidates (columns of the enriched position plus ``alert_type``)."""
    kind = F.col("alert_type")
    limit = vessel.top_speed(F.col("vessel_type"))
    accel = acceleration()

    def by_kind(values: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(kind == k, v) for k, v in values.items()])

    severity = by_kind({k: F.lit(s) for k, (s, _) in SPEED_CHECKS.items()})
    action = by_kind({k: F.lit(a) for k, (_, a) in SPEED_CHECKS.items()})
    title = by_kind(
        {
            EXCESSIVE: F.lit("Excessive Speed Detected"),
            STOP: F.lit("Sudden Stop Detected"),
            ACCELERATION: F.lit("Impossible Acceleration Detected"),
        }
    )
    name = F.coalesce("vessel_name", F.lit("null"))
    text = by_kind(
        {
            EXCESSIVE: F.format_string(
                "Vessel %s traveling at %.1f knots (max expected: %.1f knots)", name, F.col("speed"), limit
            ),
            STOP: F.format_string(
                "Vessel %s suddenly stopped from %.1f knots to %.1f knots", name, F.col("prev.speed"), F.col("speed")
            ),
            ACCELERATION: F.format_string(
                "Vessel %s acceleration rate: %.2f knots/sec (likely GPS error)", name, accel
            ),
        }
    )
    details = by_kind(
        {
            EXCESSIVE: alerting.details_map(
                current_speed=F.col("speed"),
                max_expected_speed=limit,
                vessel_type=F.col("vessel_type"),
                course=F.col("course"),
                heading=F.col("heading"),
                status=F.col("status"),
            ),
            STOP: alerting.details_map(
                previous_speed=F.col("prev.speed"),
                current_speed=F.col("speed"),
                speed_drop=F.col("prev.speed") - F.col("speed"),
            ),
            ACCELERATION: alerting.details_map(
                acceleration=accel,
                speed_change=F.abs(F.col("speed") - F.col("prev.speed")),
                time_seconds=F.col("time_since_last_update") / 1000.0,
            ),
        }
    )
    return candidates.select(
        *alerting.alert_row(
            alert_type=kind,
            severity=severity,
            mmsi=F.col("mmsi"),
            vessel_name=F.col("vessel_name"),
            latitude=F.col("latitude"),
            longitude=F.col("longitude"),
            speed=F.col("speed"),
            ts=F.col("ts"),
            seq=F.col("seq"),
            title=title,
            description=text,
            details=details,
            action_required=action,
        )
    )


def erratic_speed(positions: DataFrame, variance_limit: float = 400.0, width: str = "5 minutes") -> DataFrame:
    """Per vessel and tumbling window: speed variance over the limit, and the window maximum against the top speed."""
    stats = (
        positions.groupBy("mmsi", F.window("ts", width).alias("w"))
        .agg(
            F.count("speed").alias("n"),
            F.var_samp("speed").alias("speed_variance"),
            F.max("speed").alias("max_speed"),
            F.max("vessel_type").alias("vessel_type"),
        )
        .select("mmsi", F.col("w.start").alias("window_start"), "n", "speed_variance", "max_speed", "vessel_type")
    )
    return erratic_windows(stats, variance_limit)


def erratic_windows(stats: DataFrame, variance_limit: float = 400.0) -> DataFrame:
    """The windows of (mmsi, window_start, n, speed_variance, max_speed, vessel_type) that raise an alert."""
    over = F.col("max_speed") > vessel.top_speed(F.col("vessel_type")) * SPEED_FACTOR
    return stats.withColumn(
        "alert_type",
        F.when(over, EXCESSIVE).when(F.col("speed_variance") > variance_limit, "ERRATIC_SPEED"),
    ).where(F.col("alert_type").isNotNull())


def speed_change(
    positions: DataFrame, change_kn: float = 15.0, minutes: int = 5, seconds: int = sequence.SLICE_SECONDS
) -> DataFrame:
    """Positions whose trailing window spans more than ``change_kn`` between slowest and fastest."""
    return sequence.with_trailing(
        positions,
        {"window_min": ("min", "speed"), "window_max": ("max", "speed")},
        minutes * 60,
        keep=F.col("window_max") - F.col("window_min") > change_kn,
        seconds=max(seconds, minutes * 60),
    )


# Codes at rest or without command: at anchor, not under command, moored, aground.
RESTING_CODES = (1, 2, 5, 6)


def drift(
    with_movement: DataFrame, rest_speed_kn: float = 3.0, course_gap_deg: float = 90.0, min_leg_nm: float = 0.05
) -> DataFrame:
    """Movement that the reported state does not explain.

    RESTING: status says at rest, yet the speed between two fixes is above ``rest_speed_kn``.
    COURSE: the leg is longer than ``min_leg_nm`` and points more than ``course_gap_deg`` off the course.
    """
    hours = F.col("time_since_last_update") / 3_600_000.0
    rows = with_movement.where(F.col("prev").isNotNull()).withColumns(
        {
            "made_good_kn": F.try_divide(F.col("distance_from_previous"), hours),
            "leg_bearing": geo.initial_bearing(
                F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude")
            ),
        }
    )
    rows = rows.withColumn("course_gap", geo.angle_between(F.col("leg_bearing"), F.col("course")))
    resting = F.col("navigation_status").isin(*RESTING_CODES) & (F.col("made_good_kn") > rest_speed_kn)
    astray = (F.col("distance_from_previous") > min_leg_nm) & (F.col("course_gap") > course_gap_deg)
    return rows.withColumn("drift_reason", F.when(resting, "RESTING").when(astray, "COURSE")).where(
        F.col("drift_reason").isNotNull()
    )


def course_deviation(with_movement: DataFrame, degrees: float = 90.0) -> DataFrame:
    """Fixes whose course turned by more than ``degrees`` since the previous fix."""
    turned = geo.angle_between(F.col("course"), F.col("prev.course"))
    return with_movement.withColumn("turn", turned).where(F.col("turn") > degrees)


def signal_lost(
    positions: DataFrame, as_of: Column, gap_minutes: float = 15.0, seconds: float = sequence.SLICE_SECONDS
) -> DataFrame:
    """Silence longer than the gap: between two fixes, or from the last fix up to ``as_of``.

    One row per silence with its start (``lost_at``) and its end (``regained_at``, NULL while it lasts).
    """
    limit = int(gap_minutes * 60_000)
    fixes = positions.select("mmsi", "ts", "seq")
    silence = F.unix_millis("ts") - F.unix_millis("prev.ts")
    between = (
        sequence.with_previous(fixes, ["ts"], seconds=seconds)
        .where(silence > limit)
        .select("mmsi", F.col("prev.ts").alias("lost_at"), F.col("ts").alias("regained_at"), silence.alias("silence_ms"))
    )
    ongoing = (
        fixes.groupBy("mmsi")
        .agg(F.max("ts").alias("lost_at"))
        .withColumn("silence_ms", F.unix_millis(as_of) - F.unix_millis("lost_at"))
        .where(F.col("silence_ms") > limit)
        .select("mmsi", "lost_at", F.lit(None).cast("timestamp").alias("regained_at"), "silence_ms")
    )
    return between.unionByName(ongoing)
