"""Per-vessel sequence operators: movement, detectors, tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.operators import detect, sequence, tracks
from fairlead.plans import common
from fairlead.plans.oracle import angle, bearing, sql
from fairlead.plans.registry import query

# The dense lens has no silence of a quarter of an hour, so tracks and silences use shorter gaps here.
TRACK_GAP = 3.0
SILENCE_GAP = 5.0


@query("T-01", sql=sql("""
SELECT seq, mmsi, vessel_type, round(dist, 6) AS distance_nm, dt AS elapsed_ms, 'ID' AS flag FROM enriched""", "enriched"))
def enrich_positions(spark, sf):
    return common.enriched(spark, sf).select(
        "seq", "mmsi", "vessel_type", common.near(F.col("distance_from_previous")).alias("distance_nm"),
        F.col("time_since_last_update").alias("elapsed_ms"), "flag",
    )


def _candidates(spark, sf, kind):
    rows = detect.speed_candidates(common.enriched(spark, sf)).where(F.col("alert_type") == kind)
    return rows


@query("T-02", sql=sql("SELECT seq, mmsi, vessel_type, speed FROM checks WHERE is_fast", "checks"))
def alert_excessive_speed(spark, sf):
    return _candidates(spark, sf, detect.EXCESSIVE).select("seq", "mmsi", "vessel_type", "speed")


@query("T-03", sql=sql("SELECT seq, mmsi, prev_speed, speed FROM checks WHERE is_stop", "checks"))
def alert_sudden_stop(spark, sf):
    return _candidates(spark, sf, detect.STOP).select("seq", "mmsi", F.col("prev.speed").alias("prev_speed"), "speed")


@query("T-04", sql=sql("SELECT seq, mmsi, round(abs(speed - prev_speed) / (dt / 1e3), 6) AS acceleration FROM checks WHERE is_jump", "checks"))
def alert_acceleration(spark, sf):
    rows = _candidates(spark, sf, detect.ACCELERATION)
    return rows.select("seq", "mmsi", common.near(detect.acceleration()).alias("acceleration"))


@query("T-05", sql=sql("SELECT seq, mmsi, alert_type, severity, severity_rank, ms AS ts_ms FROM alerts", "alerts"))
def alerts_throttled(spark, sf):
    return common.alerts(spark, sf).select("seq", "mmsi", "alert_type", "severity", "severity_rank", *common.millis("ts"))


@query("T-08", "W-05", sql=sql("""
SELECT mmsi, epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_ms, count(speed) AS n, round(var_samp(speed), 4) AS speed_variance, max(speed) AS max_speed,
  CASE WHEN max(speed) > 1.5 * CASE max(vessel_type) WHEN 'PASSENGER' THEN 35e0 WHEN 'TANKER' THEN 20e0 ELSE 25e0 END THEN 'EXCESSIVE_SPEED' ELSE 'ERRATIC_SPEED' END AS alert_type
FROM valid GROUP BY mmsi, time_bucket(INTERVAL 5 MINUTE, ts)
HAVING max(speed) > 1.5 * CASE max(vessel_type) WHEN 'PASSENGER' THEN 35e0 WHEN 'TANKER' THEN 20e0 ELSE 25e0 END OR var_samp(speed) > 400""", "valid"))
def erratic_speed(spark, sf):
    rows = detect.erratic_speed(common.valid(spark, sf))
    return rows.select(
        "mmsi", F.unix_millis("window_start").alias("window_ms"), "n", common.near(F.col("speed_variance"), 4).alias("speed_variance"),
        "max_speed", "alert_type",
    )


@query("T-09", sql=sql("""
SELECT seq, mmsi, window_min, window_max FROM (
  SELECT seq, mmsi, min(speed) OVER w AS window_min, max(speed) OVER w AS window_max FROM (SELECT *, epoch_us(ts) // 1000000 AS sec FROM valid)
  WINDOW w AS (PARTITION BY mmsi ORDER BY sec RANGE BETWEEN 300 PRECEDING AND CURRENT ROW))
WHERE window_max - window_min > 15""", "valid"))
def speed_change_5min(spark, sf):
    rows = detect.speed_change(common.valid(spark, sf), seconds=common.slice_of(spark, sf))
    return rows.select("seq", "mmsi", "window_min", "window_max")


@query("T-10", "F-15", sql=sql(f"""
SELECT seq, mmsi, drift_reason, round(made_good, 4) AS made_good_kn FROM (
  SELECT *, CASE WHEN navigation_status IN (1, 2, 5, 6) AND made_good > 3 THEN 'RESTING'
    WHEN dist > 0.05 AND {angle('leg', 'course')} > 90 THEN 'COURSE' END AS drift_reason
  FROM (SELECT *, dist / (CASE WHEN dt = 0 THEN NULL ELSE dt / 36e5 END) AS made_good, {bearing('prev_lat', 'prev_lon', 'latitude', 'longitude')} AS leg
    FROM enriched WHERE prev_ts IS NOT NULL)) WHERE drift_reason IS NOT NULL""", "enriched"))
def drift(spark, sf):
    rows = detect.drift(common.moved(spark, sf))
    return rows.select("seq", "mmsi", "drift_reason", common.near(F.col("made_good_kn"), 4).alias("made_good_kn"))


@query("T-11", sql=sql(f"""
SELECT seq, mmsi, {angle('course', 'prev_course')} AS turn FROM enriched WHERE {angle('course', 'prev_course')} > 90""", "enriched"))
def course_deviation(spark, sf):
    return detect.course_deviation(common.moved(spark, sf)).select("seq", "mmsi", "turn")


@query("T-11", sql=sql("""
SELECT mmsi, epoch_ms(prev_ts) AS lost_ms, dt AS silence_ms, true AS regained FROM enriched WHERE dt > 300000
UNION ALL
SELECT mmsi, epoch_ms(max(ts)), epoch_ms((SELECT max(ts) FROM positions)) - epoch_ms(max(ts)), false FROM valid GROUP BY mmsi
HAVING epoch_ms((SELECT max(ts) FROM positions)) - epoch_ms(max(ts)) > 300000""", "enriched"))
def signal_lost(spark, sf):
    rows = detect.signal_lost(common.valid(spark, sf), common.as_of(spark, sf), SILENCE_GAP, common.slice_of(spark, sf))
    return rows.select(
        "mmsi", F.unix_millis("lost_at").alias("lost_ms"), "silence_ms", F.col("regained_at").isNotNull().alias("regained")
    )


TRACKED = f"""tracked AS (
  SELECT *, max(CASE WHEN starts THEN ts END) OVER (PARTITION BY mmsi ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS track_start,
    CASE WHEN starts THEN 0e0 ELSE dist END AS leg
  FROM (SELECT *, prev_ts IS NULL OR dt > {int(TRACK_GAP * 60_000)} AS starts FROM enriched))"""
NUMBERED = TRACKED + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY mmsi, track_start ORDER BY ts, seq) AS row_number FROM tracked)"""


def _tracked(spark, sf):
    return tracks.with_track(common.valid(spark, sf), TRACK_GAP, common.slice_of(spark, sf))


@query("T-14", sql=sql("""
SELECT mmsi, epoch_ms(track_start) AS track_start_ms, epoch_ms(max(ts)) AS track_end_ms, count(*) AS points, round(sum(leg), 5) AS distance_nm,
  round(avg(speed), 6) AS avg_speed, max(speed) AS max_speed FROM tracked GROUP BY mmsi, track_start""", "enriched", extra=TRACKED))
def tracks_summary(spark, sf):
    done = tracks.track_summary(_tracked(spark, sf))
    return done.select(
        "mmsi", *common.millis("track_start", "track_end"), "points", common.near(F.col("distance_nm"), 5).alias("distance_nm"),
        *common.rounded("avg_speed"), "max_speed",
    )


@query("T-15", sql=sql("""
SELECT seq, mmsi, round(avg(latitude) OVER w, 6) AS smooth_latitude, round(avg(longitude) OVER w, 6) AS smooth_longitude FROM numbered
WINDOW w AS (PARTITION BY mmsi, track_start ORDER BY row_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""", "enriched", extra=NUMBERED))
def track_smoothed(spark, sf):
    rows = tracks.smoothed(_tracked(spark, sf), 2)
    return rows.select("seq", "mmsi", *common.rounded("smooth_latitude", "smooth_longitude"))


@query("T-16", sql=sql("""
SELECT mmsi, seq, step, epoch_ms(ts) + step * 60000 AS ts_ms, step > 0 AS interpolated,
  round(CASE WHEN step = 0 THEN latitude ELSE latitude + (next_lat - latitude) * (step * 60000 / CAST(gap AS DOUBLE)) END, 6) AS latitude,
  round(CASE WHEN step = 0 THEN longitude ELSE longitude + (next_lon - longitude) * (step * 60000 / CAST(gap AS DOUBLE)) END, 6) AS longitude
FROM (SELECT *, unnest(CASE WHEN gap > 60000 AND gap < 300000 THEN range(0, (gap - 1) // 60000 + 1) ELSE [0] END) AS step
  FROM (SELECT *, epoch_ms(lead(ts) OVER w) - epoch_ms(ts) AS gap, lead(latitude) OVER w AS next_lat, lead(longitude) OVER w AS next_lon
    FROM valid WINDOW w AS (PARTITION BY mmsi ORDER BY ts, seq)))""", "valid"))
def track_gapfill(spark, sf):
    rows = tracks.gap_filled(common.valid(spark, sf), seconds=common.slice_of(spark, sf))
    return rows.select(
        "mmsi", "seq", F.col("step").cast("bigint").alias("step"), *common.millis("ts"), "interpolated",
        *common.rounded("latitude", "longitude"),
    )


PLANE = NUMBERED + """, /* recursive */
turned AS (SELECT mmsi, track_start, row_number AS rn, seq, latitude * 60e0 AS y, count(*) OVER t AS n, avg(latitude) OVER t AS mean_lat,
    longitude + 360e0 * sum(CASE WHEN row_number > 1 THEN floor((prev_lon - longitude) / 360e0 + 0.5e0) ELSE 0e0 END)
      OVER (PARTITION BY mmsi, track_start ORDER BY row_number ROWS UNBOUNDED PRECEDING) AS lon
  FROM numbered WINDOW t AS (PARTITION BY mmsi, track_start)),
plane AS (SELECT *, lon * 60e0 * cos(radians(mean_lat)) AS x FROM turned),
spans AS (
  SELECT mmsi, track_start, 1::BIGINT AS lo, n AS hi FROM plane WHERE rn = 1 AND n > 1
  UNION ALL
  SELECT mmsi, track_start, unnest([lo, mid]), unnest([mid, hi]) FROM (
    SELECT mmsi, track_start, lo, hi, max(off) AS far, arg_max(rn, (off, -rn)) AS mid FROM (
      SELECT s.mmsi, s.track_start, s.lo, s.hi, p.rn,
        CASE WHEN (b.x - a.x) ** 2 + (b.y - a.y) ** 2 > 0 THEN
          greatest(0e0, least(1e0, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / ((b.x - a.x) ** 2 + (b.y - a.y) ** 2))) ELSE 0e0 END AS t,
        sqrt((p.x - a.x - t * (b.x - a.x)) ** 2 + (p.y - a.y - t * (b.y - a.y)) ** 2) AS off
      FROM spans s JOIN plane a ON a.mmsi = s.mmsi AND a.track_start = s.track_start AND a.rn = s.lo
        JOIN plane b ON b.mmsi = s.mmsi AND b.track_start = s.track_start AND b.rn = s.hi
        JOIN plane p ON p.mmsi = s.mmsi AND p.track_start = s.track_start AND p.rn > s.lo AND p.rn < s.hi)
    GROUP BY mmsi, track_start, lo, hi) WHERE far > 0.5)"""


@query("T-17", sql=sql("""
SELECT mmsi, epoch_ms(track_start) AS track_start_ms, rn AS row_number, seq FROM plane
WHERE rn = 1 OR (mmsi, track_start, rn) IN (SELECT mmsi, track_start, hi FROM spans)""", "enriched", extra=PLANE))
def track_simplified(spark, sf):
    rows = tracks.simplified(_tracked(spark, sf), 0.5)
    return rows.select("mmsi", *common.millis("track_start"), "row_number", "seq")


@query("T-18", sql=sql("""
SELECT seq, mmsi, row_number FROM (SELECT *, max(row_number) OVER (PARTITION BY mmsi, track_start) AS last_row FROM numbered)
WHERE (row_number - 1) % 10 = 0 AND row_number < last_row""", "enriched", extra=NUMBERED))
def track_decimated(spark, sf):
    return tracks.decimated(_tracked(spark, sf)).select("seq", "mmsi", "row_number")


@query("K-13", sql=sql("""
SELECT mmsi, epoch_ms(track_start) AS track_start_ms, count(*) AS points, round(sum(longitude), 6) AS longitudes, round(sum(latitude), 6) AS latitudes
FROM numbered GROUP BY mmsi, track_start""", "enriched", extra=NUMBERED))
def track_features(spark, sf):
    """GeoJSON lines, one per track; count and sums of the points are read back out of the JSON text."""
    rows = tracks.track_lines(_tracked(spark, sf))
    line = F.from_json("feature", "geometry STRUCT<coordinates: ARRAY<ARRAY<DOUBLE>>>")["geometry"]["coordinates"]

    def total(place):
        return common.near(F.aggregate(line, F.lit(0.0), lambda n, p: n + p[place]))

    return rows.select(
        "mmsi", *common.millis("track_start"), F.size(line).cast("bigint").alias("points"), total(0).alias("longitudes"), total(1).alias("latitudes")
    )


@query("T-01", sql=sql("""
SELECT seq, mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY ts, seq) AS row_number,
  epoch_ms(lead(ts) OVER (PARTITION BY mmsi ORDER BY ts, seq)) AS next_ms FROM valid_long""", "valid_long"))
def fix_sequence(spark, sf):
    """Running number and the time of the following fix over thirty days, in slices of up to a day."""
    rows = common.valid_long(spark, sf).select("seq", "mmsi", "ts")
    seconds = sequence.slice_seconds(rows, longest=86_400)
    ahead = sequence.with_context(rows, following={"next": ["ts"]}, number="row_number", seconds=seconds)
    return ahead.select("seq", "mmsi", "row_number", F.unix_millis("next.ts").alias("next_ms"))


