"""Rollups and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import vessel
from fairlead.operators import rollups as ops
from fairlead.operators import reads, sequence
from fairlead.plans import common, lenses
from fairlead.plans.oracle import fragment_case, sql
from fairlead.plans.registry import query
from fairlead.sources import reference

LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, seq DESC) AS newest_rank FROM valid) WHERE newest_rank = 1)"


def daily_halves(rollup, rows):
    """State of the rows by way of the states of two halves, which is how a maintained rollup is read."""
    half = F.pmod(F.xxhash64("seq"), F.lit(2))
    parts = [rollup.state(rows.where(half == i)) for i in (0, 1)]
    return rollup.finished(rollup.merged(parts))


@query("A-01", "F-18", sql=sql("""
SELECT mmsi, vessel_name, vessel_type, epoch_ms(date_trunc('hour', ts)) AS hour_ms, count(*) AS position_count,
  round(avg(speed), 6) AS avg_speed, max(speed) AS max_speed, min(speed) AS min_speed,
  round(avg(latitude), 6) AS avg_latitude, round(avg(longitude), 6) AS avg_longitude
FROM valid_long GROUP BY mmsi, vessel_name, vessel_type, date_trunc('hour', ts)""", "valid_long"))
def movement_hourly(spark, sf):
    rollup = ops.MOVEMENT_HOURLY
    done = rollup.finished(rollup.state(common.valid_long(spark, sf)))
    return done.select(
        "mmsi", "vessel_name", "vessel_type", *common.millis("hour"), "position_count", "max_speed", "min_speed",
        *common.rounded("avg_speed", "avg_latitude", "avg_longitude"),
    )


@query("A-01", "A-04", "U-02", sql=sql("""
SELECT mmsi, epoch_ms(date_trunc('minute', ts)) AS minute_ms, count(*) AS message_count, round(avg(speed), 6) AS avg_speed,
  min(speed) AS min_speed, max(speed) AS max_speed, round(avg(latitude), 6) AS avg_latitude, round(avg(longitude), 6) AS avg_longitude
FROM valid GROUP BY mmsi, date_trunc('minute', ts)""", "valid"))
def merged_rollup_states(spark, sf):
    """The per-minute rollup again, merged from the states of two halves of the input."""
    done = daily_halves(ops.POSITIONS_PER_MINUTE, common.valid(spark, sf))
    return done.select(
        "mmsi", *common.millis("minute"), "message_count", "min_speed", "max_speed",
        *common.rounded("avg_speed", "avg_latitude", "avg_longitude"),
    )


@query("A-15", sql=sql("""
SELECT mmsi, epoch_ms(date_trunc('minute', ts)) AS minute_ms, count(*) AS message_count, round(avg(speed), 6) AS avg_speed,
  min(speed) AS min_speed, max(speed) AS max_speed, round(avg(latitude), 6) AS avg_latitude, round(avg(longitude), 6) AS avg_longitude
FROM valid GROUP BY mmsi, date_trunc('minute', ts)""", "valid"))
def positions_1min(spark, sf):
    rollup = ops.POSITIONS_PER_MINUTE
    done = rollup.finished(rollup.state(common.valid(spark, sf)))
    return done.select(
        "mmsi", *common.millis("minute"), "message_count", "min_speed", "max_speed",
        *common.rounded("avg_speed", "avg_latitude", "avg_longitude"),
    )


@query("A-02", sql=sql("""
SELECT alert_type, severity, strftime(ts, '%Y-%m-%d') AS day, count(*) AS alert_count, count(DISTINCT mmsi) AS affected_vessels
FROM alerts GROUP BY ALL""", "alerts"))
def alerts_daily(spark, sf):
    return ops.alerts_daily(common.alerts(spark, sf))


@query("A-02", sql=sql("""
SELECT alert_type, severity, strftime(ts, '%Y-%m-%d') AS day, count(*) AS alert_count, true AS close FROM alerts GROUP BY ALL""", "alerts"))
def alerts_daily_sketch(spark, sf):
    """Vessel counts out of sketches of ten minutes each, merged to days; ``close`` if within four standard errors."""
    alerts = common.alerts(spark, sf)
    minutes = F.expr("unix_millis(ts) div 600000 % 6")
    merged = ops.merge_alert_sketches([ops.alerts_daily_sketch(alerts.where(minutes == i)) for i in range(6)])
    exact = ops.alerts_daily(alerts).select("alert_type", "severity", "day", "affected_vessels")
    both = merged.withColumn("estimate", F.hll_sketch_estimate("vessel_sketch")).join(exact, ["alert_type", "severity", "day"])
    # A sketch of 2**12 registers has a standard error of 1.04 / 2**6.
    close = F.abs(F.col("estimate") - F.col("affected_vessels")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 64 * F.col("affected_vessels"))
    return both.select("alert_type", "severity", "day", "alert_count", close.alias("close"))


@query("A-03", sql=sql("""
SELECT port_id, port_name, strftime(ts, '%Y-%m-%d') AS day, count(*) AS operation_count, count(DISTINCT mmsi) AS unique_vessels,
  count(*) FILTER (WHERE operation_type = 'ARRIVAL') AS arrivals, count(*) FILTER (WHERE operation_type = 'DEPARTURE') AS departures,
  count(*) FILTER (WHERE status = 'COMPLETED') AS completed_operations
FROM operations GROUP BY ALL""", "operations"))
def port_traffic_daily(spark, sf):
    return ops.port_traffic_daily(lenses.port_operations(spark, sf))


MEASURES = ("temperature", "wind_speed", "wave_height", "visibility", "pressure", "humidity")


@query("A-04", sql=sql(f"""
SELECT grid_id, epoch_ms(date_trunc('hour', ts)) AS hour_ms, count(*) AS reading_count, {', '.join(f'round(avg({m}), 6) AS avg_{m}' for m in MEASURES)}
FROM weather GROUP BY grid_id, date_trunc('hour', ts)""", "weather"))
def weather_hourly(spark, sf):
    rollup = ops.WEATHER_HOURLY
    done = rollup.finished(rollup.state(lenses.weather(spark, sf)))
    return done.select("grid_id", *common.millis("hour"), "reading_count", *common.rounded(*rollup.averages))


@query("A-05", sql=sql("""
SELECT alert_type, severity, severity_rank, count(*) AS alert_count, epoch_ms(min(ts)) AS oldest_alert_ms, epoch_ms(max(ts)) AS latest_alert_ms
FROM alerts GROUP BY ALL ORDER BY severity DESC, alert_count DESC""", "alerts"))
def active_alerts_summary(spark, sf):
    done = ops.active_alerts_summary(common.alerts(spark, sf))
    return done.select(
        "alert_type", "severity", "severity_rank", "alert_count", *common.millis("oldest_alert", "latest_alert")
    )


@query("A-06", "T-19", sql=sql("""
SELECT count(*) AS total_vessels, count(*) FILTER (WHERE speed > 0) AS moving_vessels, count(*) FILTER (WHERE speed = 0) AS stationary_vessels,
  round(avg(speed), 6) AS avg_speed, epoch_ms(max(ts)) AS last_update_ms FROM latest""", "valid", extra=LATEST))
def fleet_status(spark, sf):
    latest = sequence.latest_per_key(common.valid(spark, sf).select("mmsi", "speed", "ts", "seq"), ["mmsi"])
    return ops.fleet_status(latest).select(
        "total_vessels", "moving_vessels", "stationary_vessels", *common.rounded("avg_speed"), *common.millis("last_update")
    )


@query("A-10", sql=sql("""
SELECT port_id, port_name, count(*) AS operation_count, epoch_ms(max(ts)) AS last_update_ms FROM operations
GROUP BY port_id, port_name ORDER BY port_name""", "operations"))
def port_list(spark, sf):
    done = reads.port_list(lenses.port_operations(spark, sf))
    return done.select("port_id", "port_name", "operation_count", *common.millis("last_update"))


STATS = """count(*) AS total_operations, count(DISTINCT mmsi) AS unique_vessels,
  sum(CASE WHEN operation_type = 'ARRIVAL' THEN 1 ELSE 0 END)::BIGINT AS arrivals,
  sum(CASE WHEN operation_type = 'DEPARTURE' THEN 1 ELSE 0 END)::BIGINT AS departures,
  sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END)::BIGINT AS completed, epoch_ms(max(ts)) AS last_update_ms"""


@query("A-11", sql=sql(f"SELECT port_id, port_name, {STATS} FROM operations WHERE port_id = 'P7' GROUP BY port_id, port_name", "operations"))
def port_stats(spark, sf):
    done = ops.port_stats(lenses.port_operations(spark, sf), "P7")
    return done.withColumn("last_update_ms", F.unix_millis("last_update")).drop("last_update")


@query("A-11", sql=sql(f"SELECT port_id, port_name, {STATS} FROM operations GROUP BY port_id, port_name", "operations"))
def port_stats_all(spark, sf):
    done = ops.port_stats(lenses.port_operations(spark, sf))
    return done.withColumn("last_update_ms", F.unix_millis("last_update")).drop("last_update")


@query("A-12", sql=sql("SELECT DISTINCT grid_id FROM weather ORDER BY grid_id", "weather"))
def weather_grids(spark, sf):
    return reads.weather_grids(lenses.weather(spark, sf))


DAILY = """count(*) AS position_count, round(avg(speed), 6) AS avg_speed, max(speed) AS max_speed,
  count(DISTINCT (latitude, longitude)) AS unique_positions"""


@query("A-14", sql=sql(f"SELECT mmsi, strftime(ts, '%Y-%m-%d') AS day, {DAILY} FROM valid_long GROUP BY mmsi, strftime(ts, '%Y-%m-%d')", "valid_long"))
def vessel_daily(spark, sf):
    return ops.vessel_daily(common.valid_long(spark, sf)).withColumn("avg_speed", common.near(F.col("avg_speed")))


@query("A-21", sql=sql(f"SELECT mmsi, strftime(ts, '%Y-%m-%d') AS day, {DAILY} FROM valid_long WHERE mmsi = 525000003 GROUP BY mmsi, strftime(ts, '%Y-%m-%d')", "valid_long"))
def vessel_year_daily(spark, sf):
    rows = common.valid_long(spark, sf)
    done = ops.vessel_year_daily(rows, 525_000_003, common.newest(rows))
    return done.withColumn("avg_speed", common.near(F.col("avg_speed")))


@query("A-16", sql=sql("""
SELECT epoch_ms(date_trunc('hour', ts)) AS hour_ms, region, count(DISTINCT mmsi) AS vessel_count, count(*) AS message_count,
  round(avg(speed), 6) AS avg_speed, string_agg(DISTINCT vessel_type, ',' ORDER BY vessel_type) AS vessel_types
FROM (SELECT *, CASE """ + " ".join(
    f"WHEN latitude BETWEEN {b.south}e0 AND {b.north}e0 AND longitude BETWEEN {b.west}e0 AND {b.east}e0 THEN '{b.name}'"
    for b in reference.BOXES) + """ END AS region FROM valid_long) WHERE region IS NOT NULL GROUP BY date_trunc('hour', ts), region""", "valid_long"))
def traffic_region_hourly(spark, sf):
    region = reference.box_name(F.col("latitude"), F.col("longitude"))
    done = ops.traffic_by_region(common.valid_long(spark, sf), region)
    return done.select(
        *common.millis("hour"), "region", "vessel_count", "message_count", *common.rounded("avg_speed"), "vessel_types"
    )


@query("A-17", sql=sql("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS messages, count(DISTINCT mmsi) AS vessels, round(avg(speed), 6) AS avg_speed
FROM valid_long WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22' GROUP BY 1""", "valid_long"))
def traffic_daily(spark, sf):
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-08", "2024-01-22"))
    done = ops.traffic_daily(common.valid_long(spark, sf), start, end)
    return done.withColumn("avg_speed", common.near(F.col("avg_speed")))


@query("A-18", sql=sql("""
SELECT floor(latitude * 10) / 10 AS lat_grid, floor(longitude * 10) / 10 AS lon_grid, count(DISTINCT mmsi) AS vessel_count
FROM valid WHERE ts >= (SELECT max(ts) FROM positions) - INTERVAL 30 MINUTE GROUP BY 1, 2 HAVING count(DISTINCT mmsi) > 5
ORDER BY vessel_count DESC""", "valid"))
def density_grid(spark, sf):
    since = common.as_of(spark, sf) - F.expr("INTERVAL 30 MINUTES")
    return ops.density_grid(common.valid(spark, sf), since)


@query("A-19", sql=sql("""
SELECT vessel_type, count(DISTINCT mmsi) AS vessel_count FROM valid_long
WHERE ts >= (SELECT max(ts) FROM valid_long) - INTERVAL 1 DAY GROUP BY vessel_type ORDER BY vessel_count DESC""", "valid_long"))
def type_distribution(spark, sf):
    rows = common.valid_long(spark, sf)
    return ops.type_distribution(rows, common.newest(rows) - F.expr("INTERVAL 1 DAY"))


@query("A-20", sql=sql("""
SELECT alert_type, count(*) AS alert_count, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count FROM alerts
WHERE ts >= (SELECT max(ts) FROM positions) - INTERVAL 7 DAY GROUP BY alert_type""", "alerts"))
def alert_stats_by_type(spark, sf):
    since = common.as_of(spark, sf) - F.expr("INTERVAL 7 DAYS")
    return ops.alert_stats_by_type(common.alerts(spark, sf), since)


@query("A-22", sql=sql("""
SELECT port_id, count(DISTINCT mmsi) AS unique_vessels, count(*) FILTER (WHERE operation_type = 'ARRIVAL') AS arrivals,
  count(*) FILTER (WHERE operation_type = 'DEPARTURE') AS departures FROM operations WHERE ts >= TIMESTAMP '1998-01-01' GROUP BY port_id""", "operations"))
def port_analytics(spark, sf):
    return ops.port_analytics(lenses.port_operations(spark, sf), F.lit("1998-01-01").cast("timestamp"))


@query("A-23", sql=sql("""
SELECT count(*) AS total_vessels, count(*) FILTER (WHERE code IN (1, 5)) AS in_port, count(*) FILTER (WHERE code NOT IN (1, 5)) AS under_way,
  count(*) FILTER (WHERE epoch_ms(now_ts) - epoch_ms(seen) <= 86400000) AS active_vessels, sum(last_hour)::BIGINT AS positions_last_hour,
  (SELECT count(*) FROM alerts) AS active_alerts
FROM (SELECT mmsi, arg_max(navigation_status, (ts, seq)) AS code, max(ts) AS seen, (SELECT max(ts) FROM positions_long) AS now_ts,
    count(*) FILTER (WHERE epoch_ms((SELECT max(ts) FROM positions_long)) - epoch_ms(ts) < 3600000) AS last_hour
  FROM valid_long GROUP BY mmsi)""", "valid_long", "alerts"))
def live_stats(spark, sf):
    now = common.newest(lenses.positions_long(spark, sf))
    return ops.live_stats(common.valid_long(spark, sf), common.alerts(spark, sf), now, active_minutes=1440)


@query("A-24", sql=sql("""
SELECT state, count(DISTINCT mmsi) FILTER (WHERE period = 'now') AS vessels_now, count(DISTINCT mmsi) FILTER (WHERE period = 'before') AS vessels_before,
  round((count(DISTINCT mmsi) FILTER (WHERE period = 'now') - count(DISTINCT mmsi) FILTER (WHERE period = 'before')) * 1e2
    / count(DISTINCT mmsi) FILTER (WHERE period = 'before'), 6) AS change_pct
FROM (SELECT mmsi, CASE WHEN age < 86400000 THEN 'now' ELSE 'before' END AS period,
    unnest(['active', CASE WHEN navigation_status IN (1, 5) THEN 'in_port' ELSE 'at_sea' END]) AS state
  FROM (SELECT *, epoch_ms((SELECT max(ts) FROM positions_long)) - epoch_ms(ts) AS age FROM valid_long) WHERE age < 172800000)
GROUP BY state""", "valid_long"))
def period_change(spark, sf):
    now = common.newest(lenses.positions_long(spark, sf))
    done = ops.period_change(common.valid_long(spark, sf), now, 24)
    return done.withColumn("change_pct", common.near(F.col("change_pct")))


@query("P-16", sql=sql(f"""
SELECT tab, count(*) AS vessels FROM (
  SELECT unnest(['all', {fragment_case('lower(vessel_type)', vessel.TYPE_CATEGORIES, 'unknown')}]) AS tab FROM latest) GROUP BY tab""", "valid", extra=LATEST))
def type_tabs(spark, sf):
    latest = sequence.latest_per_key(common.valid(spark, sf).select("mmsi", "vessel_type", "ts", "seq"), ["mmsi"])
    return reads.type_tabs(latest, vessel.type_category(F.col("vessel_type")))
