"""Scalar rules and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import geo, vessel, weather
from fairlead.operators import ports as port_ops
from fairlead.operators import validate
from fairlead.plans import common, lenses
from fairlead.plans.oracle import (
    bearing, fragment_case, hav, nav_text, sea_text, sql, top, type_of,
)
from fairlead.plans.registry import query
from fairlead.sources import reference


@query("P-01", sql=sql("""
SELECT seq, CASE WHEN mmsi <= 0 THEN 'INVALID_MMSI' WHEN abs(latitude) > 90 OR abs(longitude) > 180 THEN 'INVALID_COORDINATES'
  WHEN speed IS NULL OR speed < 0 OR speed > 102.3 THEN 'INVALID_SPEED'
  WHEN epoch_ms(ts) > epoch_ms((SELECT max(ts) FROM positions)) - 600000 + 60000 THEN 'FUTURE_TIMESTAMP'
  WHEN epoch_ms(ts) < epoch_ms((SELECT max(ts) FROM positions)) - 600000 - 3600000 THEN 'OLD_TIMESTAMP'
  ELSE 'VALID' END AS verdict FROM positions""", "positions"))
def validate_positions(spark, sf):
    """Clock set ten minutes before the newest fix, so that the future rule fires as well."""
    rows = lenses.positions(spark, sf)
    now = F.timestamp_millis(F.unix_millis(common.newest(rows)) - 600_000)
    tagged = validate.with_reject_reason(rows, now)
    return tagged.select("seq", F.coalesce("reject_reason", F.lit("VALID")).alias("verdict"))


@query("P-01", sql=sql("""
SELECT CASE WHEN speed > 102.3 OR speed < 0 THEN 'INVALID_SPEED'
  WHEN epoch_ms((SELECT max(ts) FROM positions_long)) - epoch_ms(ts) > 3600000 THEN 'OLD_TIMESTAMP' ELSE 'VALID' END AS verdict,
  count(*) AS n FROM positions_long GROUP BY 1""", "positions_long"))
def validation_verdicts(spark, sf):
    rows = lenses.positions_long(spark, sf)
    tagged = validate.with_reject_reason(rows, common.newest(rows))
    return tagged.groupBy(F.coalesce("reject_reason", F.lit("VALID")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("P-02", sql=sql("SELECT seq, mmsi > 0 AND abs(latitude) <= 90 AND abs(longitude) <= 180 AS ok FROM positions", "positions"))
def ingest_validity(spark, sf):
    return lenses.positions(spark, sf).select("seq", validate.ingest_ok().alias("ok"))


@query("P-04", "P-07", "P-09", "F-05", "F-07", sql=sql(f"""
SELECT grid_id, sea_state, {sea_text('sea_state')} AS sea_text, count(*) AS n,
  count(*) FILTER (WHERE visibility > 1000 AND sea_state <= 6 AND wind_speed < 20) AS safe,
  sum(CASE WHEN visibility > 1000 AND sea_state <= 6 AND wind_speed < 20 THEN 100 ELSE 70 END) AS score
FROM weather WHERE abs(latitude) <= 90 AND abs(longitude) <= 180 GROUP BY grid_id, sea_state""", "weather"))
def weather_safety(spark, sf):
    rows = lenses.weather(spark, sf).where(validate.located_ok())
    safe = weather.safe_for_navigation(F.col("visibility"), F.col("sea_state"), F.col("wind_speed"))
    return (
        rows.withColumn("safe", safe)
        .groupBy("grid_id", "sea_state", weather.sea_state_text(F.col("sea_state")).alias("sea_text"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("safe").alias("safe"),
            F.sum(weather.weather_score(F.col("safe"))).alias("score"),
        )
    )


@query("F-09", sql=sql("""
SELECT grid_id, condition, round(avg(intensity), 6) AS intensity, count(*) AS n FROM (
  SELECT grid_id, CASE WHEN wave_height > 4 OR wind_speed > 20 THEN 'stormy' WHEN visibility < 2 THEN 'foggy'
      WHEN humidity > 80 AND wind_speed > 5 THEN 'rainy' WHEN humidity > 60 THEN 'cloudy' ELSE 'clear' END AS condition,
    least(1e0, CASE WHEN wave_height > 4 OR wind_speed > 20 THEN (wave_height + wind_speed / 10) / 8 WHEN visibility < 2 THEN (5 - visibility) / 5
      WHEN humidity > 80 AND wind_speed > 5 THEN humidity / 100 WHEN humidity > 60 THEN humidity / 80 ELSE 0.2e0 END) AS intensity
  FROM weather) GROUP BY grid_id, condition""", "weather"))
def weather_condition(spark, sf):
    rows = lenses.weather(spark, sf)
    c = weather.weather_condition(F.col("wave_height"), F.col("wind_speed"), F.col("visibility"), F.col("humidity"))
    return (
        rows.select("grid_id", c.alias("c"))
        .groupBy("grid_id", F.col("c.type").alias("condition"))
        .agg(common.near(F.avg("c.intensity")).alias("intensity"), F.count(F.lit(1)).alias("n"))
    )


@query("F-01", "F-02", "F-10", "F-14", "F-15", sql=sql(f"""
SELECT seq, CAST(CAST(trunc(latitude * 10) AS INT) AS VARCHAR) || '_' || CAST(CAST(trunc(longitude * 10) AS INT) AS VARCHAR) AS grid_cell,
  round({hav('latitude', 'longitude', '-6.1042e0', '106.8829e0')}, 6) AS nm_to_port,
  round({bearing('latitude', 'longitude', '-6.1042e0', '106.8829e0')}, 6) AS bearing_to_port,
  round(sqrt(power(-6.1042e0 - latitude, 2) + power(106.8829e0 - longitude, 2)), 6) AS degrees_to_port,
  (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(course / 45 + 0.5) AS INT) % 8 + 1] AS octant,
  round(degrees(asin(sin(radians(latitude)) * cos(speed * 1.852e0 / 6371) + cos(radians(latitude)) * sin(speed * 1.852e0 / 6371) * cos(radians(course)))), 6) AS ahead_lat,
  round(degrees(radians(longitude) + atan2(sin(radians(course)) * sin(speed * 1.852e0 / 6371) * cos(radians(latitude)),
    cos(speed * 1.852e0 / 6371) - sin(radians(latitude)) * (sin(radians(latitude)) * cos(speed * 1.852e0 / 6371) + cos(radians(latitude)) * sin(speed * 1.852e0 / 6371) * cos(radians(course))))), 6) AS ahead_lon
FROM positions""", "positions"))
def position_geometry(spark, sf):
    """Cell, distance and bearing to a port, and the point reached after an hour at the present speed."""
    rows = lenses.positions(spark, sf)
    lat, lon = F.col("latitude"), F.col("longitude")
    _, _, _, port_lat, port_lon, *_ = reference.PORTS[1]
    ahead = geo.destination(lat, lon, F.col("course"), F.col("speed") * 1.852)
    return rows.withColumn("ahead", ahead).select(
        "seq",
        geo.position_cell(lat, lon).alias("grid_cell"),
        common.near(geo.distance_nm(lat, lon, F.lit(port_lat), F.lit(port_lon))).alias("nm_to_port"),
        common.near(geo.initial_bearing(lat, lon, F.lit(port_lat), F.lit(port_lon))).alias("bearing_to_port"),
        common.near(geo.planar_degrees(lat, lon, F.lit(port_lat), F.lit(port_lon))).alias("degrees_to_port"),
        geo.compass_octant(F.col("course")).alias("octant"),
        common.near(F.col("ahead.lat")).alias("ahead_lat"),
        common.near(F.col("ahead.lon")).alias("ahead_lon"),
    )


@query("F-03", "F-04", "F-11", sql=sql(f"""
SELECT seq, vessel_type, {top('vessel_type')} AS top_speed, {fragment_case('lower(vessel_type)', vessel.TYPE_CATEGORIES, 'unknown')} AS category
FROM (SELECT seq, {type_of('vessel_name')} AS vessel_type FROM positions)""", "positions"))
def infer_vessel_type(spark, sf):
    kind = vessel.type_from_name(F.col("vessel_name"))
    return lenses.positions(spark, sf).select("seq", kind.alias("vessel_type")).select(
        "seq",
        "vessel_type",
        vessel.top_speed(F.col("vessel_type")).alias("top_speed"),
        vessel.type_category(F.col("vessel_type")).alias("category"),
    )


@query("F-06", sql=sql(f"""
SELECT code, {nav_text('code')} AS status, count(*) AS n
FROM (SELECT CAST(user_id % 18 AS INT) AS code FROM events) GROUP BY code"""))
def nav_status(spark, sf):
    rows = lenses.table(spark, sf, "events").select((F.col("user_id") % 18).cast("int").alias("code"))
    return rows.groupBy("code", vessel.navigation_status_text(F.col("code")).alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )


SCORE = """
  100 - CASE WHEN vessel_name IS NULL OR trim(vessel_name) = '' THEN 10 ELSE 0 END - CASE WHEN speed IS NULL THEN 10 ELSE 0 END
  - CASE WHEN course IS NULL THEN 10 ELSE 0 END - CASE WHEN heading IS NULL THEN 5 ELSE 0 END
  - CASE WHEN navigation_status IS NULL THEN 5 ELSE 0 END - CASE WHEN destination IS NULL THEN 10 ELSE 0 END
  - CASE WHEN minutes > 30 THEN 20 WHEN minutes > 10 THEN 10 ELSE 0 END"""
AGED = """(SELECT *, floor((epoch_ms((SELECT max(ts) FROM positions)) - epoch_ms(ts)) / 60000.0) AS minutes FROM positions)"""


def _scored(spark, sf):
    rows = lenses.positions(spark, sf)
    score = vessel.completeness_score(
        F.col("vessel_name"), F.col("speed"), F.col("course"), F.col("heading"), F.col("navigation_status"),
        F.col("destination"), F.col("ts"), common.newest(rows),
    )
    return rows.withColumn("score", score)


@query("P-05", sql=sql(f"SELECT seq, CAST(greatest(0, {SCORE}) AS INT) AS score FROM {AGED}", "positions"))
def quality_score(spark, sf):
    return _scored(spark, sf).select("seq", "score")


@query("P-06", sql=sql(f"""
SELECT mmsi, count(*) AS kept FROM (SELECT mmsi, {SCORE} AS score FROM {AGED}) WHERE score >= 50 GROUP BY mmsi""", "positions"))
def quality_filter(spark, sf):
    kept = _scored(spark, sf).where(F.col("score") >= validate.MIN_QUALITY)
    return kept.groupBy("mmsi").agg(F.count(F.lit(1)).alias("kept"))


@query("P-03", "P-08", "P-10", "F-07", sql="""
SELECT s_suppkey AS port, s_suppkey % 10 <> 0 AS valid, s_nationkey % 3 < 2 AS operational, s_suppkey % 101 > 70 AS congested,
  CASE WHEN s_suppkey % 101 < 30 THEN 'Low' WHEN s_suppkey % 101 < 70 THEN 'Moderate' ELSE 'High' END AS congestion_text,
  CAST(CASE WHEN s_nationkey % 3 < 2 THEN 100 ELSE 50 END - CASE WHEN s_suppkey % 101 > 70 THEN 20 ELSE 0 END AS INT) AS score
FROM supplier""")
def port_state(spark, sf):
    """Suppliers as ports."""
    key = F.col("s_suppkey")
    rows = lenses.table(spark, sf, "supplier").select(
        key.alias("port"),
        F.when(key % 10 != 0, F.concat(F.lit("P"), key.cast("string"))).otherwise(F.lit(" ")).alias("port_code"),
        ((key % 120) / 10.0 - 9).alias("latitude"),
        (key % 33 + 98.0).alias("longitude"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.get(F.array(F.lit("OPERATIONAL"), F.lit("operational"), F.lit("CLOSED")), F.col("s_nationkey") % 3).alias("status"),
        (key % 101).cast("int").alias("congestion_level"),
    )
    return port_ops.with_port_state(rows).select(
        "port", validate.port_ok().alias("valid"), "operational", "congested", "congestion_text", "score"
    )


@query("P-13", "S-14", sql=sql("""
SELECT box, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM (
  SELECT mmsi, CASE """ + " ".join(
    f"WHEN latitude BETWEEN {b.south}e0 AND {b.north}e0 AND longitude BETWEEN {b.west}e0 AND {b.east}e0 THEN '{b.name}'"
    for b in reference.BOXES) + """ END AS box FROM positions) WHERE box IS NOT NULL GROUP BY box""", "positions"))
def box_subscription(spark, sf):
    lat, lon = F.col("latitude"), F.col("longitude")
    kept = lenses.positions(spark, sf).where(reference.in_any_box(lat, lon))
    return kept.groupBy(reference.box_name(lat, lon).alias("box")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("mmsi").alias("vessels")
    )


@query("P-14", sql=sql("""
SELECT seq, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM positions
WHERE seq % 5 NOT IN (1, 3)""", "positions"))
def numeric_coordinates(spark, sf):
    """Coordinates arrive as text, in two of five rows not as a number; those rows go out."""
    rows = lenses.positions(spark, sf)
    kind = F.col("seq") % 5
    texts = rows.select(
        "seq",
        F.when(kind == 1, "n/a").otherwise(F.col("latitude").cast("string")).alias("latitude"),
        F.when(kind == 3, F.lit(None)).otherwise(F.col("longitude").cast("string")).alias("longitude"),
    )
    return validate.numeric_coordinates(texts).select("seq", *common.rounded("latitude", "longitude"))


@query("P-11", "P-12", "F-19", sql=sql("""
SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'E' || CAST(event_id AS VARCHAR) ELSE sha256('ais|' || props || CAST(event_id AS VARCHAR)) END AS id,
  CASE WHEN user_id % 3 = 0 THEN epoch_ms((SELECT max(ts) FROM events)) ELSE epoch_ms(ts) END AS at_ms,
  CASE WHEN user_id % 2 = 0 THEN 'edge' ELSE 'ais' END AS collector, 'AIS_RAW' AS data_type
FROM events WHERE event_type <> 'signup'"""))
def fill_envelopes(spark, sf):
    """Blank payloads go out; missing ids, times and collectors are filled."""
    events = lenses.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seq, user = F.col("event_id"), F.col("user_id")
    rows = events.select(
        seq.alias("seq"),
        F.when(seq % 2 == 0, F.concat(F.lit("E"), seq.cast("string"))).alias("id"),
        F.when(user % 3 != 0, F.col("ts")).alias("timestamp"),
        F.when(user % 2 == 0, "edge").alias("collectorId"),
        F.lit(None).cast("string").alias("dataType"),
        F.when(F.col("event_type") != "signup", F.concat("props", seq.cast("string"))).otherwise("  ").alias("rawData"),
    )
    filled = validate.fill_envelope(rows.where(validate.payload_present()), common.newest(events), "ais", "AIS_RAW")
    return filled.select(
        "seq", "id", F.unix_millis("timestamp").alias("at_ms"), F.col("collectorId").alias("collector"),
        F.col("dataType").alias("data_type"),
    )


