"""Parameterised reads."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fairlead.operators import clustered, enrich, reads as ops, sequence
from fairlead.plans import common, lenses
from fairlead.plans.oracle import km, sql
from fairlead.plans.registry import query
from fairlead.plans.rollups import LATEST
from fairlead.plans.spatial import PORT_LAT, PORT_LON
from fairlead.session import scratch_path

MMSI = 525_000_005


@query("L-01", "P-17", sql=sql(f"""
SELECT mmsi, vessel_name, vessel_type, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, speed, course, status, epoch_ms(ts) AS ts_ms
FROM valid_long WHERE mmsi = {MMSI} AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts""", "valid_long"))
def vessel_history(spark, sf):
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-25"))
    rows = ops.vessel_history(common.valid_long(spark, sf), MMSI, start, end)
    return rows.select(
        "mmsi", "vessel_name", "vessel_type", *common.rounded("latitude", "longitude"), "speed", "course", "status",
        *common.millis("ts"),
    )


@query("P-17", sql=sql("""
SELECT mmsi, vessel_name, vessel_type, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, speed, course, heading, status,
  epoch_ms(ts) AS ts_ms, CAST(NULL AS VARCHAR) AS country, 'ID' AS flag, call_sign, imo, 'Unknown' AS destination, CAST(NULL AS VARCHAR) AS cargo_type
FROM valid""", "valid"))
def history_projection(spark, sf):
    rows = ops.history_projection(common.enriched(spark, sf))
    return rows.select(
        "mmsi", "vessel_name", "vessel_type", *common.rounded("latitude", "longitude"), "speed", "course", "heading",
        "status", *common.millis("ts"), "country", "flag", "call_sign", "imo", "destination", "cargo_type",
    )


@query("A-07", "L-09", sql=sql("""
SELECT mmsi, vessel_name, vessel_type, max(imo) AS imo, max(call_sign) AS call_sign FROM valid
WHERE contains(lower(vessel_name), 'pert') GROUP BY ALL ORDER BY vessel_name, mmsi LIMIT 20""", "valid"))
def search_vessels(spark, sf):
    rows = common.valid(spark, sf).withColumn("flag", F.lit("ID"))
    return ops.search_vessels(rows, "PERT").drop("flag")


@query("A-08", sql=sql(f"""
SELECT mmsi, vessel_name, vessel_type, imo, call_sign, destination, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, epoch_ms(ts) AS last_seen_ms
FROM valid WHERE mmsi = {MMSI} ORDER BY ts DESC, seq DESC LIMIT 1""", "valid"))
def vessel_info(spark, sf):
    rows = common.valid(spark, sf).withColumn("flag", F.lit("ID"))
    return ops.vessel_info(rows, MMSI).select(
        "mmsi", "vessel_name", "vessel_type", "imo", "call_sign", "destination",
        *common.rounded("latitude", "longitude"), *common.millis("last_seen"),
    )


@query("A-09", sql=sql("""
SELECT mmsi, vessel_name, vessel_type, epoch_ms(max(ts)) AS last_seen_ms, count(*) AS position_count FROM valid_long
WHERE ts >= (SELECT max(ts) FROM positions_long) - INTERVAL 12 HOUR GROUP BY mmsi, vessel_name, vessel_type
ORDER BY max(ts) DESC, mmsi LIMIT 1000""", "valid_long"))
def active_vessels(spark, sf):
    since = common.newest(lenses.positions_long(spark, sf)) - F.expr("INTERVAL 12 HOURS")
    rows = common.valid_long(spark, sf).withColumn("flag", F.lit("ID"))
    return ops.active_vessels(rows, since).select(
        "mmsi", "vessel_name", "vessel_type", *common.millis("last_seen"), "position_count"
    )


@query("J-02", sql=sql("""
SELECT v.mmsi, v.vessel_name, v.vessel_type, round(l.latitude, 6) AS latitude, round(l.longitude, 6) AS longitude, epoch_ms(l.ts) AS ts_ms
FROM vessels v LEFT JOIN latest l ON v.mmsi = l.mmsi WHERE contains(lower(v.vessel_name), '#0000001')""", "vessels", "valid", extra=LATEST))
def vessel_search_position(spark, sf):
    found = ops.vessel_search_with_position(lenses.vessels(spark, sf), common.valid(spark, sf), "#0000001")
    return found.select("mmsi", "vessel_name", "vessel_type", *common.rounded("latitude", "longitude"), *common.millis("ts"))


OPERATION = "operation_id, port_id, mmsi, operation_type, berth_number, status, epoch_ms(ts) AS ts_ms"


def _operations(rows):
    return rows.select("operation_id", "port_id", "mmsi", "operation_type", "berth_number", "status", *common.millis("ts"))


@query("L-02", sql=sql(f"SELECT {OPERATION} FROM operations WHERE port_id = 'P3' ORDER BY ts DESC, seq DESC LIMIT 10", "operations"))
def port_operations(spark, sf):
    return _operations(ops.newest_operations(lenses.port_operations(spark, sf), F.col("port_id") == "P3"))


@query("L-02", sql=sql(f"SELECT {OPERATION} FROM operations WHERE mmsi = {MMSI} ORDER BY ts DESC, seq DESC LIMIT 10", "operations"))
def vessel_operations(spark, sf):
    return _operations(ops.newest_operations(lenses.port_operations(spark, sf), F.col("mmsi") == MMSI))


@query("L-03", sql=sql(f"SELECT {OPERATION} FROM operations WHERE operation_id = 'OP77'", "operations"))
def operation_by_id(spark, sf):
    return _operations(ops.operation_by_id(lenses.port_operations(spark, sf), "OP77"))


READING = "grid_id, round(temperature, 6) AS temperature, wind_speed, round(wave_height, 6) AS wave_height, humidity, epoch_ms(ts) AS ts_ms"


@query("L-04", sql=sql(f"SELECT {READING} FROM weather WHERE grid_id = '-61_1070' ORDER BY ts DESC, seq DESC LIMIT 1", "weather"))
def weather_by_grid(spark, sf):
    return ops.weather_by_grid(lenses.weather(spark, sf), "-61_1070").select(
        "grid_id", *common.rounded("temperature"), "wind_speed", *common.rounded("wave_height"), "humidity",
        F.col("timestamp").alias("ts_ms"),
    )


@query("L-07", sql=sql("""
SELECT mmsi, vessel_name, len(list_intersect(string_split(lower(vessel_name), ' '), ['mv', 'sinar', '12'])) AS score FROM latest
WHERE len(list_intersect(string_split(lower(vessel_name), ' '), ['mv', 'sinar', '12'])) > 0
ORDER BY score DESC, vessel_name, mmsi LIMIT 20""", "valid", extra=LATEST))
def name_match(spark, sf):
    latest = sequence.latest_per_key(common.valid(spark, sf).select("mmsi", "vessel_name", "ts", "seq"), ["mmsi"])
    return ops.name_match(latest, "MV sinar 12").select("mmsi", "vessel_name", F.col("score").cast("bigint").alias("score"))


@query("L-07", sql=sql("""
SELECT mmsi, vessel_name FROM vessels WHERE starts_with(lower(vessel_name), 'customer#00000') ORDER BY vessel_name, mmsi LIMIT 20""", "vessels"))
def name_autocomplete(spark, sf):
    return ops.name_autocomplete(lenses.vessels(spark, sf), "Customer#00000")


@query("T-19", sql=sql("""
SELECT mmsi, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, speed, epoch_ms(ts) AS ts_ms FROM latest""", "valid", extra=LATEST))
def latest_positions(spark, sf):
    latest = sequence.latest_per_key(
        common.valid(spark, sf).select("mmsi", "latitude", "longitude", "speed", "ts", "seq"), ["mmsi"]
    )
    return latest.select("mmsi", *common.rounded("latitude", "longitude"), "speed", *common.millis("ts"))


@query("T-21", sql=sql("""
SELECT mmsi, seq, rank FROM (SELECT mmsi, seq, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, seq DESC) AS rank FROM valid_long) WHERE rank <= 100""", "valid_long"))
def last_n_positions(spark, sf):
    rows = sequence.newest_n_per_key(common.valid_long(spark, sf).select("mmsi", "ts", "seq"), 100, ["mmsi"])
    return rows.select("mmsi", "seq", F.col("rank").cast("bigint").alias("rank"))


@query("J-01", sql=sql("""
SELECT p.seq, p.mmsi, coalesce(v.vessel_type, p.vessel_type) AS vessel_type, coalesce(v.flag_state, 'ID') AS flag, coalesce(p.destination, 'Unknown') AS destination,
  v.length AS length, v.width AS width, v.eta_ms AS eta_ms, v.draught AS draught, v.mmsi IS NOT NULL AS known_vessel FROM valid p LEFT JOIN vessels v ON p.mmsi = v.mmsi""", "valid", "vessels"))
def enrich_with_master(spark, sf):
    rows = enrich.with_master(common.valid(spark, sf).drop("vessel_type"), lenses.vessels(spark, sf))
    return rows.select("seq", "mmsi", "vessel_type", "flag", "destination", "length", "width", *common.millis("eta"), "draught", "known_vessel")


@query("X-03", sql=sql("""
SELECT t.vessel_type, t.fixes, t.vessels, t.avg_speed, coalesce(o.operations, 0) AS operations
FROM (SELECT vessel_type, count(*) AS fixes, count(DISTINCT mmsi) AS vessels, round(avg(speed), 6) AS avg_speed FROM valid GROUP BY vessel_type) t
LEFT JOIN (SELECT v.vessel_type, count(*) AS operations FROM (SELECT DISTINCT mmsi, vessel_type FROM valid) v
  JOIN operations p ON p.mmsi = v.mmsi AND p.status = 'IN_PROGRESS' GROUP BY v.vessel_type) o USING (vessel_type)""", "valid", "operations"))
def sql_views(spark, sf):
    """Plain SQL over the operators' tables as views, in a session of its own."""
    views = {"valid_positions": common.valid(spark, sf), "port_operations": lenses.port_operations(spark, sf)}
    return spark.sql(
        """
        SELECT t.vessel_type, t.fixes, t.vessels, t.avg_speed, coalesce(o.operations, 0) AS operations
        FROM (SELECT vessel_type, count(*) AS fixes, count(DISTINCT mmsi) AS vessels, round(avg(speed), 6) AS avg_speed
              FROM {valid_positions} GROUP BY vessel_type) t
        LEFT JOIN (SELECT v.vessel_type, count(*) AS operations
                   FROM (SELECT DISTINCT mmsi, vessel_type FROM {valid_positions}) v
                   JOIN {port_operations} p ON p.mmsi = v.mmsi AND p.status = 'IN_PROGRESS' GROUP BY v.vessel_type) o
        ON o.vessel_type = t.vessel_type
        """,
        **views,
    )


@lru_cache(maxsize=64)
def _stored(app: str, sf: str, name: str):
    """A stored table of the given data, written once per application."""
    spark = SparkSession.active()
    path = scratch_path(spark, name)
    if name == "positions":
        rows = common.valid_long(spark, sf)
        held = clustered.KeyedHistory(path, ("mmsi",), rows.schema)
        held.append(rows)
    elif name == "weather":
        rows = lenses.weather(spark, sf)
        held = clustered.KeyedHistory(path, ("grid_id",), rows.schema, buckets=4)
        held.append(rows)
    elif name == "places":
        recent = common.valid(spark, sf).where(F.col("ts") > common.as_of(spark, sf) - F.expr("INTERVAL 1 HOUR"))
        rows = sequence.latest_per_key(recent.select("mmsi", "latitude", "longitude", "ts", "seq"), ["mmsi"])
        held = clustered.PlacedTable(path, rows.schema)
        held.write(rows)
    else:
        # The names as they were in the first half of the fixes, and then as they are, with the master's beside them.
        latest = sequence.latest_per_key(common.valid(spark, sf).select("mmsi", "vessel_name", "ts", "seq"), ["mmsi"])
        held = clustered.NameIndex(path)
        held.add(latest.select("mmsi", F.concat(F.lit("OLD MV "), "vessel_name").alias("name")), 0)
        held.add(latest.select("mmsi", F.col("vessel_name").alias("name")), 1)
    return held


def stored(spark, sf, name):
    return _stored(spark.sparkContext.applicationId, sf, name)


@query("L-01", "P-17", sql=sql(f"""
SELECT mmsi, vessel_name, vessel_type, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, speed, course, status, epoch_ms(ts) AS ts_ms
FROM valid_long WHERE mmsi = {MMSI} AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""", "valid_long"))
def stored_vessel_history(spark, sf):
    """One vessel's track out of a history that is stored by key and time."""
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-25"))
    rows = ops.history_projection(stored(spark, sf, "positions").between(spark, [MMSI], start, end))
    return rows.select("mmsi", "vessel_name", "vessel_type", *common.rounded("latitude", "longitude"), "speed", "course", "status", *common.millis("ts"))


@query("L-04", sql=sql(f"SELECT {READING} FROM weather WHERE grid_id = '-61_1070' ORDER BY ts DESC, seq DESC LIMIT 1", "weather"))
def stored_weather_by_grid(spark, sf):
    rows = stored(spark, sf, "weather").newest(spark, ["-61_1070"])
    return rows.select("grid_id", *common.rounded("temperature"), "wind_speed", *common.rounded("wave_height"), "humidity", *common.millis("ts"))


@query("L-05", sql=sql(f"""
SELECT mmsi, round(d, 5) AS distance_km FROM (SELECT mmsi, {km('latitude', 'longitude', f'{PORT_LAT}e0', f'{PORT_LON}e0')} AS d FROM latest
  WHERE ts > (SELECT max(ts) FROM positions) - INTERVAL 1 HOUR) ORDER BY d, mmsi LIMIT 10""", "valid", extra=LATEST))
def stored_nearest_vessels(spark, sf):
    """The ten vessels nearest to a harbour, by rings of stored cells."""
    rows = stored(spark, sf, "places").nearest(spark, PORT_LAT, PORT_LON, 10)
    return rows.select("mmsi", common.near(F.col("distance_km"), 5).alias("distance_km"))


@query("L-05", sql=sql(f"""
SELECT point_id, rank, mmsi, round(d, 5) AS distance_km FROM (
  SELECT p.mmsi AS point_id, l.mmsi, row_number() OVER (PARTITION BY p.mmsi ORDER BY {km('p.latitude', 'p.longitude', 'l.latitude', 'l.longitude')}, l.mmsi)::INT AS rank,
    {km('p.latitude', 'p.longitude', 'l.latitude', 'l.longitude')} AS d
  FROM (SELECT * FROM latest WHERE mmsi % 5 = 0) p, latest l WHERE l.ts > (SELECT max(ts) FROM positions) - INTERVAL 1 HOUR) WHERE rank <= 5""", "valid", extra=LATEST))
def nearest_vessels_join(spark, sf):
    """The five vessels nearest to each of a set of places, here the places of every fifth vessel."""
    latest = sequence.latest_per_key(common.valid(spark, sf).select("mmsi", "latitude", "longitude", "ts", "seq"), ["mmsi"])
    points = latest.where("mmsi % 5 = 0").select(F.col("mmsi").alias("point_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    rows = stored(spark, sf, "places").nearest_join(points, 5)
    return rows.select("point_id", "rank", "mmsi", common.near(F.col("distance_km"), 5).alias("distance_km"))


@query("L-07", sql=sql("""
SELECT mmsi, vessel_name, len(list_intersect(string_split(lower(vessel_name), ' '), ['mv', 'sinar', '12'])) AS score FROM latest
WHERE len(list_intersect(string_split(lower(vessel_name), ' '), ['mv', 'sinar', '12'])) > 0
ORDER BY score DESC, vessel_name, mmsi LIMIT 20""", "valid", extra=LATEST))
def indexed_name_match(spark, sf):
    """Names by words of a stored index, after every name was replaced once."""
    rows = stored(spark, sf, "names").match(spark, "MV sinar 12")
    return rows.select("mmsi", F.col("name").alias("vessel_name"), "score")


@query("L-07", sql=sql("""
SELECT mmsi, vessel_name FROM latest WHERE starts_with(lower(vessel_name), 'mt pert') ORDER BY vessel_name, mmsi LIMIT 20""", "valid", extra=LATEST))
def indexed_autocomplete(spark, sf):
    return stored(spark, sf, "names").complete(spark, "MT Pert").select("mmsi", F.col("name").alias("vessel_name"))
