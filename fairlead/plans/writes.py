"""Table writes: keyed merges, history, retention, expiring views, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.operators import reads, sequence, tables, tracks
from fairlead.plans import common, lenses
from fairlead.plans.oracle import sql
from fairlead.plans.registry import query
from fairlead.plans.sequences import NUMBERED, TRACK_GAP
from fairlead.session import scratch_path
from fairlead.sources import files

THIRD_MS = 1_200_000


def _current(spark, rows, rule, batches):
    """A current-state table after some batches, one of them delivered twice, with a compaction in between."""
    table = tables.CurrentTable(spark, scratch_path(spark, "current"), rule, rows.schema)
    for number, part in enumerate(batches):
        table.upsert(part, number)
        if number == 1:
            table.upsert(part, number)
            table.compact(0)
    return table


@query("K-04", "U-02", sql=sql("""
SELECT mmsi, arg_max(speed, (ts, seq)) AS speed, epoch_ms(max(ts)) AS ts_ms, round(arg_max(latitude, (ts, seq)), 6) AS latitude,
  arg_min(call_sign || '-' || seq, (ts, seq)) AS call_sign FROM valid GROUP BY mmsi""", "valid"))
def upsert_positions(spark, sf):
    """Three batches of twenty minutes: the call sign stays as first written, the rest follows the newest fix."""
    rows = common.valid(spark, sf).withColumns(
        {
            "call_sign": F.concat_ws("-", "call_sign", F.col("seq").cast("string")),
            "flag": F.lit("ID"),
            "eta": F.lit(None).cast("timestamp"),
            "draught": F.lit(None).cast("double"),
        }
    ).select(*tables.POSITION_RULE.keys, *tables.POSITION_RULE.mutable, *tables.POSITION_RULE.fixed, "seq")
    third = F.expr(f"(unix_millis(ts) div {THIRD_MS}) % 3")
    start = F.expr(f"({lenses.EPOCH_2024_US} div 1000 div {THIRD_MS}) % 3")
    number = F.pmod(third - start, F.lit(3))
    table = _current(spark, rows, tables.POSITION_RULE, [rows.where(number == i) for i in range(3)])
    return table.read().select("mmsi", "speed", *common.millis("ts"), *common.rounded("latitude"), "call_sign")


@query("K-05", sql=sql("""
SELECT grid_id, round(arg_max(temperature, (ts, seq)), 6) AS temperature, arg_max(wind_speed, (ts, seq)) AS wind_speed, epoch_ms(max(ts)) AS ts_ms,
  round(any_value(latitude), 6) AS latitude FROM weather GROUP BY grid_id""", "weather"))
def upsert_weather(spark, sf):
    """Batches out of time order; a late batch does not roll a cell back."""
    rows = lenses.weather(spark, sf)
    late = F.col("ts") < F.lit("1998-01-01").cast("timestamp")
    table = _current(spark, rows, tables.WEATHER_RULE, [rows.where(~late), rows.where(late)])
    return table.read().select("grid_id", *common.rounded("temperature"), "wind_speed", *common.millis("ts"), *common.rounded("latitude"))


def operation_messages(spark, sf):
    """Two messages of every port operation: as announced, and as it happened a minute later."""
    rows = lenses.port_operations(spark, sf)
    announced = rows.withColumns({"status": F.lit("SCHEDULED"), "departure_time": F.col("arrival_time")})
    happened = rows.withColumns({"berth_number": F.lit("B99"), "ts": F.timestamp_micros(F.unix_micros("ts") + 60_000_000)})
    return announced, happened


@query("K-06", "L-03", sql=sql("""
SELECT operation_id, port_id, status, 'B' || (seq % 12) AS berth_number, epoch_ms(departure_time) AS departure_ms, epoch_ms(ts) AS ts_ms FROM operations""", "operations"))
def upsert_port_operations(spark, sf):
    """Announced first, then as it happened: only status and departure follow the second message."""
    announced, happened = operation_messages(spark, sf)
    table = _current(spark, announced, tables.PORT_OPERATION_RULE, [announced, happened])
    return table.read().select(
        "operation_id", "port_id", "status", "berth_number", F.unix_millis("departure_time").alias("departure_ms"),
        *common.millis("ts"),
    )


@query("K-07", "J-09", sql=sql("SELECT alert_id, seq FROM (SELECT sha256(alert_type || '|' || mmsi || '|' || epoch_us(ts) || '|' || seq) AS alert_id, seq FROM alerts) WHERE seq % 2 = 1", "alerts"))
def insert_alerts_once(spark, sf):
    """A batch with repeats, inserted beside the alerts that are already stored."""
    rows = common.alerts(spark, sf).select("alert_id", "seq")
    stored = rows.where(F.col("seq") % 2 == 0)
    return reads.without_known(rows.unionByName(rows), stored, "alert_id")


@query("K-08", sql=sql("""
SELECT strftime(ts, '%Y%m') AS ym, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, epoch_ms(date_trunc('second', max(ts))) AS newest_ms FROM valid_long GROUP BY 1, 2""", "valid_long"))
def history_append(spark, sf):
    """Two batches appended to a monthly partitioned history, the second one delivered twice."""
    rows = common.valid_long(spark, sf)
    path = scratch_path(spark, "history")
    half = F.pmod(F.xxhash64("seq"), F.lit(2))
    for number in (0, 1, 1):
        tables.append_history(rows.where(half == number), path, number)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("ym").cast("string").alias("ym"), F.date_format("date", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.unix_millis(F.max("ts")).alias("newest_ms")
    )


@query("K-09", "F-18", sql=sql("""
SELECT strftime(ts, '%Y%m') AS ym, count(*) AS n FROM weather WHERE CAST(ts AS DATE) >= CAST((SELECT max(ts) FROM weather) AS DATE) - INTERVAL 12 MONTH GROUP BY 1""", "weather"))
def history_retention(spark, sf):
    rows = tables.with_history_columns(lenses.weather(spark, sf))
    kept = tables.retained(rows, common.newest(rows), tables.RETENTION_YEARS["weather"])
    return kept.groupBy("ym").agg(F.count(F.lit(1)).alias("n"))


@query("K-10", sql=sql("""
SELECT mmsi, speed, epoch_ms(ts) AS ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, seq DESC) AS r FROM valid)
WHERE r = 1 AND epoch_ms((SELECT max(ts) FROM positions)) - epoch_ms(ts) < 60000""", "valid"))
def live_positions(spark, sf):
    """Latest positions with a life of one minute."""
    rows = common.valid(spark, sf).select("mmsi", "speed", "ts", "seq")
    return tables.live_values(rows, ["mmsi"], common.as_of(spark, sf), 60).select("mmsi", "speed", *common.millis("ts"))


VALUE_DAYS = 30


@query("K-10", sql=sql(f"""
SELECT grid_id, wind_speed, epoch_ms(ts) AS ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY ts DESC, seq DESC) AS r FROM weather)
WHERE r = 1 AND epoch_ms((SELECT max(ts) FROM weather)) - epoch_ms(ts) < {VALUE_DAYS * 86_400_000}""", "weather"))
def live_weather(spark, sf):
    """Latest readings of every cell with a life of a month."""
    rows = lenses.weather(spark, sf).select("grid_id", "wind_speed", "ts", "seq")
    done = tables.live_values(rows, ["grid_id"], common.newest(rows), VALUE_DAYS * 86_400)
    return done.select("grid_id", "wind_speed", *common.millis("ts"))


@query("K-10", sql=sql(f"""
SELECT port_id, operation_id, epoch_ms(ts) AS ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY port_id ORDER BY ts DESC, seq DESC) AS r FROM operations)
WHERE r = 1 AND epoch_ms((SELECT max(ts) FROM operations)) - epoch_ms(ts) < {VALUE_DAYS * 86_400_000}""", "operations"))
def live_port_operations(spark, sf):
    """Latest operation of every port with a life of a month."""
    rows = lenses.port_operations(spark, sf).select("port_id", "operation_id", "ts", "seq")
    done = tables.live_values(rows, ["port_id"], common.newest(rows), VALUE_DAYS * 86_400)
    return done.select("port_id", "operation_id", *common.millis("ts"))


@query("K-10", sql=sql("""
SELECT mmsi, alert_type, epoch_ms(ts) AS ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, seq DESC) AS r FROM alerts)
WHERE r = 1 AND epoch_ms((SELECT max(ts) FROM alerts)) - epoch_ms(ts) < 3600000""", "alerts"))
def live_alerts(spark, sf):
    """Latest alert of every vessel, which lives for an hour."""
    rows = common.alerts(spark, sf).select("mmsi", "alert_type", "ts", "seq")
    done = tables.live_values(rows, ["mmsi"], common.newest(rows), tables.VALUE_SECONDS["alerts"])
    return done.select("mmsi", "alert_type", *common.millis("ts"))


@query("K-11", sql=sql("""
SELECT mmsi, alert_id, epoch_ms(last_ts) + 600000 AS expires_ms FROM (
  SELECT *, max(ts) OVER (PARTITION BY mmsi) AS last_ts, max(CASE WHEN reborn THEN ts END) OVER (PARTITION BY mmsi) AS born
  FROM (SELECT *, prev IS NULL OR epoch_ms(ts) - epoch_ms(prev) >= 600000 AS reborn
    FROM (SELECT *, sha256(alert_type || '|' || mmsi || '|' || epoch_us(ts) || '|' || seq) AS alert_id, lag(ts) OVER (PARTITION BY mmsi ORDER BY ts, seq) AS prev FROM alerts)))
WHERE ts >= born AND epoch_ms(last_ts) + 600000 > epoch_ms((SELECT max(ts) FROM alerts))""", "alerts"))
def live_alert_sets(spark, sf):
    """Alert ids per vessel, kept alive by every new one for ten minutes."""
    rows = common.alerts(spark, sf).select("mmsi", "alert_id", "ts", "seq")
    done = tables.live_members(rows, "mmsi", "alert_id", common.newest(rows), 600, slice_seconds=common.slice_of(spark, sf))
    return done.select("mmsi", "alert_id", F.unix_millis("expires_at").alias("expires_ms"))


LIFE_DAYS = 12


@query("K-11", sql=sql(f"""
SELECT port_id, operation_id, epoch_ms(last_ts) + {LIFE_DAYS * 86_400_000} AS expires_ms FROM (
  SELECT *, max(ts) OVER (PARTITION BY port_id) AS last_ts, max(CASE WHEN reborn THEN ts END) OVER (PARTITION BY port_id) AS born
  FROM (SELECT *, prev IS NULL OR epoch_ms(ts) - epoch_ms(prev) >= {LIFE_DAYS * 86_400_000} AS reborn
    FROM (SELECT *, lag(ts) OVER (PARTITION BY port_id ORDER BY ts, seq) AS prev FROM operations)))
WHERE ts >= born AND epoch_ms(last_ts) + {LIFE_DAYS * 86_400_000} > epoch_ms((SELECT max(ts) FROM operations))""", "operations"))
def live_operation_sets(spark, sf):
    """Operation ids per port, kept alive by every new one."""
    rows = lenses.port_operations(spark, sf)
    seconds = sequence.slice_seconds(rows, keys=["port_id"], longest=90 * 86_400)
    done = tables.live_members(
        rows, "port_id", "operation_id", common.newest(rows), LIFE_DAYS * 86_400, slice_seconds=seconds
    )
    return done.select("port_id", "operation_id", F.unix_millis("expires_at").alias("expires_ms"))


@query("K-09", "K-08", sql=sql("""
SELECT strftime(ts, '%Y%m') AS ym, count(*) AS n, round(sum(temperature), 4) AS temperatures FROM weather
WHERE strftime(ts, '%Y%m') >= strftime((SELECT max(ts) FROM weather) - INTERVAL 12 MONTH, '%Y%m') GROUP BY 1""", "weather"))
def history_purged(spark, sf):
    """A history of many years whose expired months are deleted; what the folders still hold."""
    rows, path = lenses.weather(spark, sf), scratch_path(spark, "weather-history")
    tables.append_history(rows, path, 0, ("grid_id", "ts"))
    newest = rows.agg(F.max("ts").alias("ts")).first()["ts"].date()
    tables.drop_expired_months(spark, path, newest, tables.RETENTION_YEARS["weather"])
    left = spark.read.parquet(path)
    return left.groupBy(F.col("ym").cast("string").alias("ym")).agg(F.count(F.lit(1)).alias("n"), common.near(F.sum("temperature"), 4).alias("temperatures"))


@query("K-13", sql=sql("""
SELECT format, mmsi, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, epoch_ms(ts) AS ts_ms FROM valid, (VALUES ('csv'), ('json'), ('parquet')) f(format)""", "valid"))
def export_selection(spark, sf):
    """A selection written in each format and read back from the files; GeoJSON has its own entry."""
    rows = common.valid(spark, sf).select("mmsi", "latitude", "longitude", "ts")
    folder = scratch_path(spark, "export")
    found = []
    for fmt in ("csv", "json", "parquet"):
        files.export(rows, f"{folder}/{fmt}", fmt)
        back = spark.read.schema("mmsi bigint, latitude double, longitude double, ts timestamp").format(fmt)
        stored = (back.option("header", True) if fmt == "csv" else back).load(f"{folder}/{fmt}")
        found.append(stored.select(F.lit(fmt).alias("format"), "mmsi", *common.rounded("latitude", "longitude"), *common.millis("ts")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("K-13", sql=sql("""
SELECT mmsi, epoch_ms(track_start) AS track_start_ms, row_number::INT AS row_number, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM numbered""", "enriched", extra=NUMBERED))
def export_geojson(spark, sf):
    """Feature lines written as text and read back as JSON, point by point."""
    tracked = tracks.with_track(common.valid(spark, sf), TRACK_GAP, common.slice_of(spark, sf))
    path = scratch_path(spark, "geojson")
    files.export(tracks.track_lines(tracked), path, "geojson")
    feature = "type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<DOUBLE>>>, properties STRUCT<mmsi: BIGINT, track_start: BIGINT>"
    lines = spark.read.schema(feature).json(path).where("type = 'Feature' AND geometry.type = 'LineString'")
    points = lines.select("properties.mmsi", F.col("properties.track_start").alias("track_start_ms"), F.posexplode("geometry.coordinates").alias("at", "p"))
    return points.select("mmsi", "track_start_ms", (F.col("at") + 1).alias("row_number"), common.near(F.col("p")[0]).alias("longitude"), common.near(F.col("p")[1]).alias("latitude"))
