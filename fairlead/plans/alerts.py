"""Alert tables: texts, rules, ranking, search, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import vessel
from fairlead.operators import conditions, detect, enrich, proximity, reads, rules, spatial
from fairlead.plans import common
from fairlead.plans.oracle import sql, top
from fairlead.plans.registry import query
from fairlead.plans.sequences import SILENCE_GAP
from fairlead.plans.spatial import EVENTS, PAIRS
from fairlead.sources import reference


@query("F-17", "F-19", sql=sql(f"""
SELECT seq, alert_type, CASE alert_type WHEN 'EXCESSIVE_SPEED' THEN 'Excessive Speed Detected' WHEN 'SUDDEN_STOP' THEN 'Sudden Stop Detected' ELSE 'Impossible Acceleration Detected' END AS title,
  CASE alert_type WHEN 'EXCESSIVE_SPEED' THEN printf('Vessel %s traveling at %s knots (max expected: %.1f knots)', coalesce(vessel_name, 'null'), printf('%.1f', round(speed, 1)), {top('vessel_type')})
    WHEN 'SUDDEN_STOP' THEN printf('Vessel %s suddenly stopped from %s knots to %s knots', coalesce(vessel_name, 'null'), printf('%.1f', round(prev_speed, 1)), printf('%.1f', round(speed, 1)))
    ELSE printf('Vessel %s acceleration rate: %s knots/sec (likely GPS error)', coalesce(vessel_name, 'null'), printf('%.2f', round(abs(speed - prev_speed) / (dt / 1e3), 2))) END AS description,
  alert_type = 'EXCESSIVE_SPEED' AS action_required,
  sha256(alert_type || '|' || mmsi || '|' || epoch_us(ts) || '|' || seq) AS alert_id
FROM alerts""", "alerts"))
def alert_texts(spark, sf):
    return common.alerts(spark, sf).select("seq", "alert_type", "title", "description", "action_required", "alert_id")


RULES = (
    rules.Rule(1, "Fast", "SPEED", "speed", ">", 60.0),
    rules.Rule(2, "Silent", "AIS_LOST", "silence_minutes", ">=", 4.0),
    rules.Rule(3, "Slow leg", "CUSTOM", "distance_nm", "<", 0.2),
    rules.Rule(4, "Retired", "SPEED", "speed", ">", 0.0, False),
)


@query("T-23", sql=sql("""
SELECT seq, 1 AS rule_id, 'SPEED' AS alert_type, 'WARNING' AS severity, round(speed, 4) AS metric_value FROM enriched WHERE speed > 60
UNION ALL SELECT seq, 2, 'AIS_LOST', 'CRITICAL', round(dt / 6e4, 4) FROM enriched WHERE dt / 6e4 >= 4
UNION ALL SELECT seq, 3, 'CUSTOM', 'LOW', round(dist, 4) FROM enriched WHERE dist < 0.2""", "enriched"))
def rule_alerts(spark, sf):
    metrics = {
        "speed": F.col("speed"),
        "silence_minutes": F.col("time_since_last_update") / 60_000.0,
        "distance_nm": F.col("distance_from_previous"),
    }
    hits = rules.rule_hits(common.moved(spark, sf), rules.rule_table(spark, RULES), metrics)
    return rules.rule_alerts(hits).select(
        "seq", F.col("details")["rule_id"].cast("int").alias("rule_id"), "alert_type", "severity",
        common.near(F.col("details")["metric_value"].cast("double"), 4).alias("metric_value"),
    )


# Rules as they are stored: the conditions are JSON texts.
STORED_RULES = (
    (1, "Fast tanker", "SPEED", '{"and": [{"metric": "vessel_type", "op": "=", "value": "TANKER"}, {"or": [{"metric": "speed", "op": ">", "value": 70}, {"metric": "top_speed_share", "op": ">=", "value": 4}]}]}', "WARNING", True),
    (2, "Odd while resting", "CUSTOM", '{"and": [{"or": [{"metric": "navigation_status", "op": "=", "value": 1}, {"metric": "navigation_status", "op": "=", "value": 5}]}, {"not": {"or": [{"metric": "speed", "op": "<=", "value": 3}, {"metric": "distance_nm", "op": "<", "value": 1}]}}]}', "LOW", True),
    (3, "Silent and back", "AIS_LOST", '{"and": [{"metric": "silence_minutes", "op": ">=", "value": 3}, {"not": {"metric": "vessel_type", "op": "=", "value": "TANKER"}}, {"not": {"and": [{"metric": "speed", "op": ">", "value": 20}, {"metric": "distance_nm", "op": ">", "value": 2}]}}]}', "CRITICAL", True),
    (4, "Off", "SPEED", '{"metric": "speed", "op": ">", "value": 0}', "WARNING", False),
    (5, "Fast", "SPEED", '{"metric": "speed", "op": ">", "value": 70}', None, True),
    (6, "Unreadable", "SPEED", '{"metric": "speed", "op": "~", "value": 70}', "LOW", True),
    (7, "Never read", "CUSTOM", '{"or": [{"metric": "mood", "op": "=", "value": "bad"}, {"and": [{"metric": "speed", "op": ">", "value": 100}, {"metric": "speed", "op": ">", "value": 100}]}]}', "LOW", True),
)


def stored_rules(spark):
    return spark.createDataFrame(list(STORED_RULES), "id int, rule_name string, rule_type string, conditions string, severity string, is_active boolean")


@query("T-23", sql=sql("""
SELECT seq, 1 AS rule_id, 'WARNING' AS severity FROM enriched WHERE vessel_type = 'TANKER' AND (speed > 70 OR speed / 20e0 >= 4)
UNION ALL SELECT seq, 2, 'LOW' FROM enriched WHERE (navigation_status = 1 OR navigation_status = 5) AND NOT (speed <= 3 OR dist < 1)
UNION ALL SELECT seq, 3, 'CRITICAL' FROM enriched WHERE dt / 6e4 >= 3 AND NOT vessel_type = 'TANKER' AND NOT (speed > 20 AND dist > 2)
UNION ALL SELECT seq, 5, NULL FROM enriched WHERE speed > 70
UNION ALL SELECT seq, 7, 'LOW' FROM enriched WHERE speed > 100""", "enriched"))
def rule_conditions(spark, sf):
    """Stored rules with nested conditions, over enriched positions."""
    rows = common.enriched(spark, sf).withColumn("top_speed", vessel.top_speed(F.col("vessel_type")))
    metrics = {
        "speed": F.col("speed"), "vessel_type": F.col("vessel_type"), "navigation_status": F.col("navigation_status"),
        "silence_minutes": F.col("time_since_last_update") / 60_000.0, "distance_nm": F.col("distance_from_previous"),
        "top_speed_share": F.col("speed") / F.col("top_speed"),
    }
    return conditions.matches(rows, stored_rules(spark), metrics).select("seq", "rule_id", "severity")


@query("U-01", "X-01", sql=sql(f"""
SELECT alert_type, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM (
  SELECT 'EXCESSIVE_SPEED' AS alert_type, mmsi FROM checks WHERE is_fast
  UNION ALL SELECT 'SUDDEN_STOP', mmsi FROM checks WHERE is_stop
  UNION ALL SELECT 'IMPOSSIBLE_ACCELERATION', mmsi FROM checks WHERE is_jump
  UNION ALL SELECT 'COLLISION_RISK', mmsi_a FROM risks WHERE tcpa < 600
  UNION ALL SELECT 'SIGNAL_LOST', mmsi FROM enriched WHERE dt > {int(SILENCE_GAP * 60_000)}
  UNION ALL SELECT CASE WHEN event = 'ENTRY' AND geofence_type = 'RESTRICTED' THEN 'RESTRICTED_AREA_ENTRY' WHEN event = 'ENTRY' THEN 'GEOFENCE_ENTRY' ELSE 'GEOFENCE_EXIT' END, mmsi
    FROM fence_events JOIN fences USING (fence_id) WHERE CASE event WHEN 'ENTRY' THEN alert_on_entry ELSE alert_on_exit END)
GROUP BY alert_type""", "checks", "hits", "fences", extra=PAIRS + ",\n" + EVENTS))
def all_alerts(spark, sf):
    """Every detector over the same positions, as one table of the common alert schema."""
    fences, seconds = reference.fences(spark), common.slice_of(spark, sf)

    def speed(rows):
        return detect.speed_alert_rows(detect.speed_candidates(enrich.enriched(rows, seconds)))

    def fence(rows):
        return spatial.fence_alerts(spatial.fence_events(rows, fences, seconds), fences)

    def collision(rows):
        return proximity.collision_alerts(
            proximity.collision_risk(proximity.close_pairs(proximity.window_fixes(rows)))
        )

    def silence(rows):
        long_gap = rules.Rule(0, "Signal Lost", "SIGNAL_LOST", "gap_minutes", ">", SILENCE_GAP)
        gap = {"gap_minutes": F.col("time_since_last_update") / 60_000.0}
        return rules.rule_alerts(rules.rule_hits(enrich.with_movement(rows, seconds), rules.rule_table(spark, [long_gap]), gap))

    both = detect.run_detectors(common.valid(spark, sf), [speed, fence, collision, silence])
    return both.groupBy("alert_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mmsi").alias("vessels"))


@query("T-20", sql=sql("SELECT seq, alert_type, ms AS ts_ms FROM alerts ORDER BY ts DESC, seq DESC LIMIT 100", "alerts"))
def newest_alerts(spark, sf):
    return reads.newest_alerts(common.alerts(spark, sf)).select("seq", "alert_type", *common.millis("ts"))


@query("L-06", sql=sql("SELECT seq, severity, severity_rank, ms AS ts_ms FROM alerts ORDER BY severity_rank DESC, ts DESC", "alerts"))
def alerts_ranked(spark, sf):
    return reads.ranked_alerts(common.alerts(spark, sf)).select("seq", "severity", "severity_rank", *common.millis("ts"))


@query("L-08", sql=sql("""
SELECT seq, alert_type FROM alerts WHERE alert_type IN ('EXCESSIVE_SPEED', 'SUDDEN_STOP') AND ts >= (SELECT max(ts) FROM positions) - INTERVAL 7 DAY""", "alerts"))
def alert_search(spark, sf):
    since = common.as_of(spark, sf) - F.expr("INTERVAL 7 DAYS")
    return reads.alert_search(common.alerts(spark, sf), "speed stop", since).select("seq", "alert_type")


@query("T-22", sql=sql("""
SELECT seq, ms + 86400000 < (SELECT epoch_ms(max(ts)) + 84600000 FROM positions) AS resolved,
  CASE WHEN ms + 86400000 < (SELECT epoch_ms(max(ts)) + 84600000 FROM positions) THEN ms + 86400000 END AS resolved_at_ms FROM alerts""", "alerts"))
def alerts_autoresolved(spark, sf):
    """Looked at 23.5 hours after the newest fix: the first half of the alerts has lapsed."""
    now = F.timestamp_millis(F.unix_millis(common.as_of(spark, sf)) + 84_600_000)
    return reads.auto_resolved(common.alerts(spark, sf), now).select("seq", "resolved", *common.millis("resolved_at"))
