"""Fences, neighbourhoods and collisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import proximity, sequence, throttle
from fairlead.operators import spatial as ops
from fairlead.plans import common, lenses
from fairlead.plans.oracle import hav, hits_of, km, sql
from fairlead.plans.registry import query
from fairlead.plans.rollups import LATEST
from fairlead.sources import reference

PORT_LAT, PORT_LON = -6.1042, 106.8829


@query("J-03", "F-08", sql=sql("""
SELECT h.mmsi, h.fence_id, f.fence_name AS name, f.geofence_type, f.alert_on_entry FROM latest_hits h JOIN fences f USING (fence_id)""",
    "valid", "edges", "fences", extra=LATEST + ",\n" + hits_of("latest", "latest_hits")))
def geofence_membership(spark, sf):
    rows = ops.fence_membership(common.valid(spark, sf), reference.fences(spark))
    return rows.select("mmsi", "fence_id", "name", "geofence_type", "alert_on_entry")


EVENTS = """placed AS (
  SELECT v.mmsi, v.seq, v.ts, v.prev_seq, v.next_seq FROM (
    SELECT mmsi, seq, ts, lag(seq) OVER w AS prev_seq, lead(seq) OVER w AS next_seq FROM valid WINDOW w AS (PARTITION BY mmsi ORDER BY ts, seq)) v),
fence_events AS (
  SELECT h.mmsi, h.seq, h.fence_id, 'ENTRY' AS event FROM hits h JOIN placed p USING (mmsi, seq)
  WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.mmsi = h.mmsi AND b.fence_id = h.fence_id AND b.seq = p.prev_seq)
  UNION ALL
  SELECT h.mmsi, p.next_seq, h.fence_id, 'EXIT' FROM hits h JOIN placed p USING (mmsi, seq)
  WHERE p.next_seq IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits b WHERE b.mmsi = h.mmsi AND b.fence_id = h.fence_id AND b.seq = p.next_seq))"""


@query("T-06", "J-08", sql=sql("SELECT mmsi, seq, fence_id, event FROM fence_events", "valid", "hits", extra=EVENTS))
def geofence_events(spark, sf):
    rows = ops.fence_events(common.valid(spark, sf), reference.fences(spark), common.slice_of(spark, sf))
    return rows.select("mmsi", "seq", "fence_id", "event")


@query("T-07", sql=sql("""
SELECT mmsi, seq, fence_id, CASE WHEN event = 'ENTRY' AND geofence_type = 'RESTRICTED' THEN 'RESTRICTED_AREA_ENTRY'
    WHEN event = 'ENTRY' THEN 'GEOFENCE_ENTRY' ELSE 'GEOFENCE_EXIT' END AS alert_type,
  CASE WHEN event = 'ENTRY' AND geofence_type = 'RESTRICTED' THEN 'CRITICAL' ELSE 'INFO' END AS severity
FROM fence_events JOIN fences USING (fence_id) WHERE CASE event WHEN 'ENTRY' THEN alert_on_entry ELSE alert_on_exit END""",
    "valid", "hits", "fences", extra=EVENTS))
def geofence_alerts(spark, sf):
    fences = reference.fences(spark)
    rows = ops.fence_alerts(ops.fence_events(common.valid(spark, sf), fences, common.slice_of(spark, sf)), fences)
    return rows.select("mmsi", "seq", F.col("details")["fence_id"].cast("int").alias("fence_id"), "alert_type", "severity")


@query("J-05", sql=sql(f"""
SELECT mmsi, round({km('latitude', 'longitude', f'{PORT_LAT}e0', f'{PORT_LON}e0')}, 5) AS distance_km FROM latest
WHERE {km('latitude', 'longitude', f'{PORT_LAT}e0', f'{PORT_LON}e0')} <= 12""", "valid", extra=LATEST))
def vessels_within_radius(spark, sf):
    latest = sequence.latest_per_key(common.valid(spark, sf).select("mmsi", "latitude", "longitude", "ts", "seq"), ["mmsi"])
    rows = ops.within_radius(latest, PORT_LAT, PORT_LON, 12.0)
    return rows.select("mmsi", common.near(F.col("distance_km"), 5).alias("distance_km"))


@query("S-14", sql=sql(f"""
SELECT mmsi, port_id, port_id IN ('SGSIN', 'NLRTM', 'USNYC', 'CNSHA') AS monitored, round(d, 5) AS distance_km FROM (
  SELECT mmsi, port_id, d, row_number() OVER (PARTITION BY mmsi ORDER BY d, port_id) AS r FROM (
    SELECT mmsi, port_id, {km('latitude', 'longitude', 'port_lat', 'port_lon')} AS d FROM latest,
      (VALUES ('SGSIN', 1.2644e0, 103.8542e0), ('IDTPP', -6.1042e0, 106.8829e0), ('MYPKG', 3.0039e0, 101.3944e0)) AS p(port_id, port_lat, port_lon)))
WHERE r = 1""", "valid", extra=LATEST))
def nearest_sample_port(spark, sf):
    """The sample port that each vessel is nearest to, and whether it is one of the monitored ones."""
    latest = sequence.latest_per_key(common.valid(spark, sf).select("mmsi", "latitude", "longitude", "ts", "seq"), ["mmsi"])
    rows = ops.nearest_port(latest, [(p[0], p[3], p[4]) for p in reference.PORTS])
    monitored = F.col("port_id").isin(*reference.MONITORED_PORTS)
    return rows.select("mmsi", "port_id", monitored.alias("monitored"), common.near(F.col("distance_km"), 5).alias("distance_km"))


@query("L-05", sql=sql(f"""
SELECT mmsi, round(d, 5) AS distance_km FROM (SELECT mmsi, {km('latitude', 'longitude', f'{PORT_LAT}e0', f'{PORT_LON}e0')} AS d FROM latest
  WHERE ts > (SELECT max(ts) FROM positions) - INTERVAL 1 HOUR) ORDER BY d, mmsi LIMIT 10""", "valid", extra=LATEST))
def nearest_vessels(spark, sf):
    recent = common.valid(spark, sf).where(F.col("ts") > common.as_of(spark, sf) - F.expr("INTERVAL 1 HOUR"))
    latest = sequence.latest_per_key(recent.select("mmsi", "latitude", "longitude", "ts", "seq"), ["mmsi"])
    return ops.nearest(latest, PORT_LAT, PORT_LON, 10).select("mmsi", common.near(F.col("distance_km"), 5).alias("distance_km"))


@query("P-15", sql=sql("""
SELECT mmsi, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, seq DESC) AS r FROM valid WHERE ts > (SELECT max(ts) FROM positions) - INTERVAL 30 MINUTE)
WHERE r = 1 AND latitude BETWEEN -7.25e0 AND 1.2e0 AND longitude BETWEEN 103e0 AND 113e0""", "valid"))
def viewport(spark, sf):
    since = common.as_of(spark, sf) - F.expr("INTERVAL 30 MINUTES")
    rows = common.valid(spark, sf).select("mmsi", "latitude", "longitude", "ts", "seq")
    return ops.in_view(rows, -7.25, 103.0, 1.2, 113.0, since).select("mmsi", *common.rounded("latitude", "longitude"))


def _near(km_limit: str, lat: str, lon: str) -> str:
    return f"""
SELECT grid_id, round(latitude, 6) AS latitude, longitude, epoch_ms(ts) AS ts_ms, humidity, round(d, 5) AS distance_km
FROM (SELECT *, {km('latitude', 'longitude', lat, lon)} AS d FROM weather) WHERE d <= {km_limit} ORDER BY ts DESC, d, seq LIMIT 10"""


@query("J-06", sql=sql(_near("50", "-6.11e0", "106.89e0"), "weather"))
def weather_nearby(spark, sf):
    rows = ops.weather_near(lenses.weather(spark, sf), -6.11, 106.89)
    return rows.select(
        "grid_id", *common.rounded("latitude"), "longitude", *common.millis("ts"), "humidity",
        common.near(F.col("distance_km"), 5).alias("distance_km"),
    )


@query("L-09", sql=sql(_near("166.5", "-5.5e0", "107.5e0"), "weather"))
def weather_for_bounds(spark, sf):
    rows = ops.weather_for_view(lenses.weather(spark, sf), south=-6.5, west=106.0, north=-4.5, east=109.0)
    return rows.select(
        "grid_id", *common.rounded("latitude"), "longitude", *common.millis("ts"), "humidity",
        common.near(F.col("distance_km"), 5).alias("distance_km"),
    )


@query("S-14", sql=sql("""
SELECT p.latitude AS point_lat, p.longitude AS point_lon, count(w.seq) AS readings, round(avg(w.wave_height), 6) AS avg_wave
FROM (VALUES """ + ", ".join(f"({a}e0, {b}e0)" for a, b in reference.WEATHER_POINTS) + """) p(latitude, longitude)
LEFT JOIN weather w ON w.grid_id = CAST(CAST(floor(p.latitude * 10 + 0.5) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(round(p.longitude) * 10 + 0.5) AS BIGINT) AS VARCHAR)
GROUP BY p.latitude, p.longitude""", "weather"))
def weather_at_points(spark, sf):
    """Readings in the grid cell of each monitoring point (longitudes of the lens are whole degrees)."""
    points = reference.weather_points(spark).withColumn(
        "grid_id", geo.weather_cell(F.col("latitude"), F.round("longitude"))
    )
    readings = lenses.weather(spark, sf).groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("readings"), F.avg("wave_height").alias("avg_wave")
    )
    return points.join(readings, "grid_id", "left").select(
        F.col("latitude").alias("point_lat"), F.col("longitude").alias("point_lon"),
        F.coalesce("readings", F.lit(0)).alias("readings"), *common.rounded("avg_wave"),
    )


# Sliding windows of 30 s every 10 s: a fix is in the three that hold it.
PAIRS = f"""slots AS (
  SELECT mmsi, latitude, longitude, speed, course, ts, seq, unnest([0, 1, 2]) AS back FROM valid),
fixes AS (
  SELECT * FROM (SELECT *, make_timestamp((epoch_us(ts) // 10000000 - back) * 10000000) AS window_start,
      row_number() OVER (PARTITION BY mmsi, (epoch_us(ts) // 10000000 - back) ORDER BY ts DESC, seq DESC) AS r FROM slots) WHERE r = 1),
pairs AS (
  SELECT a.window_start, a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.latitude AS lat_a, a.longitude AS lon_a, b.latitude AS lat_b, b.longitude AS lon_b,
    a.speed AS speed_a, b.speed AS speed_b, a.course AS course_a, b.course AS course_b, {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS distance_nm
  FROM fixes a JOIN fixes b ON a.window_start = b.window_start AND a.mmsi < b.mmsi AND abs(a.latitude - b.latitude) < 0.01
  WHERE {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} < 0.5),
approach AS (
  SELECT *, CASE WHEN vx * vx + vy * vy > 1e-9 THEN -(x * vx + y * vy) / (vx * vx + vy * vy) END AS h
  FROM (SELECT *, (lon_b - lon_a) * 60 * cos(radians((lat_a + lat_b) / 2)) AS x, (lat_b - lat_a) * 60 AS y,
      speed_b * sin(radians(course_b)) - speed_a * sin(radians(course_a)) AS vx,
      speed_b * cos(radians(course_b)) - speed_a * cos(radians(course_a)) AS vy FROM pairs)),
risks AS (
  SELECT *, h * 3600 AS tcpa, sqrt(power(x + vx * h, 2) + power(y + vy * h, 2)) AS cpa FROM approach
  WHERE h >= 0 AND h * 3600 < 1800 AND sqrt(power(x + vx * h, 2) + power(y + vy * h, 2)) < 0.5)"""


def _pairs(spark, sf, **how):
    return proximity.close_pairs(proximity.window_fixes(common.valid(spark, sf)), **how)


@query("J-04", "W-06", sql=sql("""
SELECT epoch_ms(window_start) AS window_start_ms, mmsi_a, mmsi_b, round(distance_nm, 6) AS distance_nm FROM pairs""", "valid", extra=PAIRS))
def proximity_pairs(spark, sf):
    return _pairs(spark, sf).select(
        *common.millis("window_start"), "mmsi_a", "mmsi_b", common.near(F.col("distance_nm")).alias("distance_nm")
    )


@query("T-12", sql=sql("""
SELECT epoch_ms(window_start) AS window_start_ms, mmsi_a, mmsi_b, round(tcpa, 4) AS tcpa_seconds, round(cpa, 5) AS cpa_nm,
  CASE WHEN tcpa < 300 THEN 'HIGH' WHEN tcpa < 600 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM risks""", "valid", extra=PAIRS))
def collision_risk(spark, sf):
    rows = proximity.collision_risk(_pairs(spark, sf))
    return rows.select(
        *common.millis("window_start"), "mmsi_a", "mmsi_b", common.near(F.col("tcpa_seconds"), 4).alias("tcpa_seconds"),
        common.near(F.col("cpa_nm"), 5).alias("cpa_nm"), "risk",
    )


@query("T-13", sql=sql("""
SELECT mmsi_a, mmsi_b, ms AS window_start_ms FROM pair_chain""", "valid", extra="/* recursive */ " + PAIRS + """,
urgent AS MATERIALIZED (SELECT mmsi_a, mmsi_b, epoch_ms(window_start) AS ms FROM risks WHERE tcpa < 600),
pair_chain AS (
  SELECT mmsi_a, mmsi_b, min(ms) AS ms FROM urgent GROUP BY mmsi_a, mmsi_b
  UNION ALL
  SELECT u.mmsi_a, u.mmsi_b, min(u.ms) FROM pair_chain c JOIN urgent u ON u.mmsi_a = c.mmsi_a AND u.mmsi_b = c.mmsi_b AND u.ms > c.ms + 300000
  GROUP BY u.mmsi_a, u.mmsi_b, c.ms)"""))
def collision_alerts(spark, sf):
    """At most one collision alert per pair in five minutes."""
    pairs = _pairs(spark, sf, slide=proximity.SLIDE, together=True)
    risks = proximity.collision_risk(pairs, within_seconds=proximity.COLLISION_SECONDS)
    passed = throttle.throttled(
        risks.select(*proximity.ALERTED, *throttle.TOGETHER), ["mmsi_a", "mmsi_b"], ts="window_start", order=["tcpa_seconds"], seconds=common.slice_of(spark, sf)
    )
    rows = proximity.collision_alerts(passed)
    return rows.select(
        F.get("involved_mmsis", F.lit(0)).alias("mmsi_a"), F.get("involved_mmsis", F.lit(1)).alias("mmsi_b"),
        F.unix_millis("ts").alias("window_start_ms"),
    )
