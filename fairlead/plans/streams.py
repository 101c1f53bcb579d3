"""Streaming jobs over the driver's tables: each reads a file stream to its end and returns what it wrote.

The input is a folder of time slices, one per micro-batch, so state crosses batches in every query; an end marker
closes the windows, sessions and timers that are still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fairlead.operators import detect, enrich, rollups, tables
from fairlead.plans import common, ingest, lenses, writes
from fairlead.plans.oracle import sql
from fairlead.plans.registry import CATALOG, query
from fairlead.plans.sequences import SILENCE_GAP, TRACK_GAP, TRACKED
from fairlead.plans.spatial import EVENTS, PAIRS
from fairlead.session import children, dated, scratch_path, stored_table
from fairlead.sources import files, reference, wire
from fairlead.streaming import alerts, fences, job, sessions, state, windows


# Rows of a staged slice, which one task writes; the fewest slices.
SLICE_ROWS = 1_000_000
LEAST_SLICES = 5
#: A vessel that does not exist: its one fix, long after all others, lets the watermark pass every open window.
END = -1


def in_slices(spark: SparkSession, rows: DataFrame, marker: dict[str, Column] | None = None) -> str:
    """Rows as a folder of time slices, one file each; ``marker`` adds a last row that closes windows.

    One job ranges the rows over time by quantiles, so that a burst fills more slices and not a larger one. A file
    stream reads files by their time of change, which is set in the order of the slices.
    """
    folder = scratch_path(spark, "slices")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ts")).alias("last")).first()
    slices = max(LEAST_SLICES, -(-found["n"] // SLICE_ROWS))
    rows.repartitionByRange(slices, "ts", "seq").sortWithinPartitions("ts", "seq").write.parquet(f"{folder}/rows")
    if marker:
        last = rows.limit(1).withColumns({**marker, "ts": F.timestamp_micros(F.lit(found["last"] + 10**12))})
        last.coalesce(1).write.parquet(f"{folder}/zend")
    written = [f"{folder}/{part}/{n}" for part in ("rows", "zend") for n in children(spark, f"{folder}/{part}") if n.endswith(".parquet")]
    for i, path in enumerate(written):
        dated(spark, path, 1_000_000_000_000 + 1000 * i)
    return folder


def slices_stream(session: SparkSession, folder: str) -> DataFrame:
    """The slices of a folder as a stream, one file per micro-batch, oldest first."""
    schema = session.read.parquet(f"{folder}/rows").schema
    return session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def valid_stream(session: SparkSession, sf: str, compression: int = lenses.COMPRESSION) -> DataFrame:
    """The valid positions in time slices, and the end marker."""
    rows = common.valid_rows(lenses.positions_from_events(lenses.table(session, sf, "events"), compression))
    return slices_stream(session, in_slices(session, rows, {"mmsi": F.lit(END).cast("long")}))


def ended(rows: DataFrame, key: str = "mmsi") -> DataFrame:
    """Without what the end marker left."""
    return rows.where(F.col(key) != END)


def closed_windows(positions: DataFrame, sinks: alerts.CollisionAlerts, checkpoint: str) -> StreamingQuery:
    """Start the job that hands on the windows of a stream. The end marker leaves in the batch: a filter of the stream would be
    moved to before the watermark, which then would not pass the last windows."""
    return job.run_batches(job.proximity_stream(positions), lambda rows, batch_id: sinks.write(ended(rows), batch_id), checkpoint)


def finish(started: StreamingQuery) -> None:
    started.awaitTermination()
    if started.exception():
        raise started.exception()


def collected(rows: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table keyed by batch, and read that."""
    folder = scratch_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    finish(job.run_batches(rows, write, f"{folder}/checkpoint", mode=mode))
    return spark.read.parquet(f"{folder}/rows")


def run_sinks(spark: SparkSession, sf: str) -> job.PositionSinks:
    """The whole position job: enrichment, detection and the fan-out to topics, history and current state."""
    session = job.stream_session(spark)
    folder = scratch_path(spark, "positions-job")
    shape = job.as_current(common.enriched(spark, sf), lenses.vessels(spark, sf)).schema
    current = tables.CurrentTable(session, f"{folder}/current", tables.POSITION_RULE, shape)
    sinks = job.PositionSinks(folder, current, master=lenses.vessels(session, sf))
    finish(job.run_positions(ended(valid_stream(session, sf)), sinks, f"{folder}/checkpoint"))
    return job.PositionSinks(folder, tables.CurrentTable(spark, f"{folder}/current", tables.POSITION_RULE, shape))


@query("W-01", "W-03", "W-04", "T-01", "K-08", sql=sql("""
SELECT seq, mmsi, vessel_type, round(dist, 6) AS distance_nm, dt AS elapsed_ms FROM enriched""", "enriched"))
def stream_enrich_detect(spark, sf):
    rows = run_sinks(spark, sf).history(spark, "positions_history")
    return rows.select(
        "seq", "mmsi", "vessel_type", common.near(F.col("distance_from_previous")).alias("distance_nm"),
        F.col("time_since_last_update").alias("elapsed_ms"),
    )


@query("T-05", "K-02", "W-08", sql=sql("SELECT seq, mmsi, alert_type, severity FROM alerts", "alerts"))
def stream_alerts(spark, sf):
    """Alerts of the stateful step, which must be those of the batch throttle."""
    session = job.stream_session(spark)
    rows = collected(job.alerts_of(state.enriched_stream(ended(valid_stream(session, sf)))).select(
        "seq", "mmsi", "alert_type", "severity"), spark, "alerts")
    return rows.drop("batch_id")


@query("J-01", "K-01", "K-02", "K-04", "K-12", "W-08", sql=sql("""
SELECT 'positions_history' AS sink, mmsi, epoch_ms(ts) // 1000 * 1000 AS ts_ms, speed AS value, vessel_type AS kind, seq, NULL::DOUBLE AS draught, NULL::BIGINT AS eta_ms FROM valid
UNION ALL SELECT 'vessel-positions', mmsi, epoch_ms(ts), speed, vessel_type, NULL, NULL, NULL FROM valid
UNION ALL SELECT 'alerts_history', mmsi, ms // 1000 * 1000, NULL, alert_type, seq, NULL, NULL FROM alerts
UNION ALL SELECT 'vessel-alerts', mmsi, ms, NULL, alert_type, NULL, NULL, NULL FROM alerts
UNION ALL SELECT 'current', p.mmsi, p.ts_ms, p.value, p.kind, NULL, v.draught, v.eta_ms
  FROM (SELECT mmsi, epoch_ms(max(ts)) AS ts_ms, arg_max(speed, (ts, seq)) AS value, arg_min(vessel_type, (ts, seq)) AS kind FROM valid GROUP BY mmsi) p LEFT JOIN vessels v USING (mmsi)""", "valid", "alerts", "vessels"))
def stream_fan_out(spark, sf):
    """What every sink of the position job shows to its readers, row by row."""
    sinks = run_sinks(spark, sf)

    def rows(sink, frame, ts_ms, value, kind, seq=None, draught=None, eta=None):
        given = lambda name, type_: (F.lit(None) if name is None else F.col(name)).cast(type_)
        return frame.select(
            F.lit(sink).alias("sink"), F.col("mmsi").cast("long").alias("mmsi"), ts_ms.alias("ts_ms"), given(value, "double").alias("value"), F.col(kind).alias("kind"),
            given(seq, "long").alias("seq"), given(draught, "double").alias("draught"), F.unix_millis(given(eta, "timestamp")).alias("eta_ms"),
        )

    def told(name, fields, at):
        """A topic's JSON texts; instants are seconds with nine decimals."""
        parsed = sinks.topic(spark, name).select(F.from_json("value", fields).alias("m")).select("m.*")
        return parsed.withColumn("ms", F.floor(F.col(at).cast("decimal(30,9)") * 1000).cast("long"))

    positions = told("vessel-positions", "mmsi string, speed string, vesselType string, timestamp string", "timestamp")
    alerts = told("vessel-alerts", "mmsi string, alertType string, alertTime string", "alertTime")
    found = [
        rows("positions_history", sinks.history(spark, "positions_history"), F.unix_millis("ts"), "speed", "vessel_type", "seq"),
        rows("vessel-positions", positions, F.col("ms"), "speed", "vesselType"),
        rows("alerts_history", sinks.history(spark, "alerts_history"), F.unix_millis("ts"), None, "alert_type", "seq"),
        rows("vessel-alerts", alerts, F.col("ms"), None, "alertType"),
        rows("current", sinks.latest(spark), F.unix_millis("ts"), "speed", "vessel_type", draught="draught", eta="eta"),
    ]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return both


@query("S-01", "S-02", "S-03", "K-14", "W-02", sql=sql(f"""
SELECT reason, count(*) AS n FROM (SELECT coalesce({ingest.REASON}, CASE WHEN speed > 102.3 THEN 'INVALID_SPEED' ELSE 'GOOD' END) AS reason FROM positions)
GROUP BY reason""", "positions"))
def stream_topic_decode(spark, sf):
    """Envelope texts in a topic folder, decoded, validated and split as a stream; rejects go to their own table."""
    session = job.stream_session(spark)
    folder = scratch_path(spark, "topics")
    ingest.envelope_texts(spark, sf).select("value").write.text(f"{folder}/ais-raw-data")
    decoded = wire.positions_from_envelopes(files.topic(session, "ais-raw-data", directory=folder))
    now = F.lit(None).cast("timestamp")
    failed = job.validate.position_reject_reason(now, check_age=False)
    tagged = decoded.withColumn("reject_reason", F.coalesce("reject_reason", failed))
    finish(job.run_rejects(tagged, folder, f"{folder}/rejects-checkpoint"))
    good = job.event_time(tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"))
    kept = collected(good.select("mmsi", "ts"), spark, "decoded")
    rejects = spark.read.parquet(f"{folder}/rejects").select(F.col("reject_reason").alias("reason"))
    both = rejects.unionByName(kept.select(F.lit("GOOD").alias("reason")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("W-09", "A-01", sql=sql("""
SELECT mmsi, vessel_name, vessel_type, epoch_ms(date_trunc('hour', ts)) AS hour_ms, count(*) AS position_count, round(avg(speed), 6) AS avg_speed, max(speed) AS max_speed
FROM valid_long GROUP BY mmsi, vessel_name, vessel_type, date_trunc('hour', ts)""", "valid_long"))
def stream_movement_hourly(spark, sf):
    session = job.stream_session(spark)
    rows = enrich.with_inferred_type(ended(valid_stream(session, sf, 1)))
    folder = scratch_path(spark, "rollup")
    sink = job.RollupSink(f"{folder}/states", rollups.MOVEMENT_HOURLY)
    finish(job.run_rollup(rows, sink, f"{folder}/checkpoint"))
    return sink.read(spark).select(
        "mmsi", "vessel_name", "vessel_type", *common.millis("hour"), "position_count", *common.rounded("avg_speed"), "max_speed"
    )


def _watched(spark: SparkSession, sf: str, folder: str, before_batch) -> DataFrame:
    """Events of the fence log in ``folder``, to which ``before_batch`` may append while the stream runs."""
    session = job.stream_session(spark)
    watch = fences.FenceWatch.at(session, folder, lambda s: s.read.parquet(f"{folder}/fences"), common.slice_of(spark, sf))

    def write(rows: DataFrame, batch_id: int) -> None:
        before_batch(session, batch_id)
        watch.write(rows, batch_id)

    finish(job.run_batches(ended(valid_stream(session, sf)), write, f"{folder}/checkpoint"))
    return watch.events(spark).select("mmsi", "seq", "fence_id", "event")


def _fence_log(spark: SparkSession, folder: str) -> None:
    reference.fences(spark).withColumn("changed_at", F.lit(None).cast("timestamp")).write.parquet(f"{folder}/fences")


@query("T-06", "J-08", sql=sql("SELECT mmsi, seq, fence_id, event FROM fence_events", "valid", "hits", extra=EVENTS))
def stream_geofence_events(spark, sf):
    folder = scratch_path(spark, "fences")
    _fence_log(spark, folder)
    return _watched(spark, sf, folder, lambda session, batch_id: None)


#: Fences that are switched off at two fifths of the time and on again at seven tenths; the log hears of it on the way.
SWITCHED = (1, 3, 8)
LIVE_HITS = f"""span AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM valid),
live_hits AS (SELECT hits.* FROM hits, span WHERE NOT (fence_id IN {SWITCHED} AND epoch_us(ts) >= a + (b - a) * 2 // 5 AND epoch_us(ts) < a + (b - a) * 7 // 10)),
""" + EVENTS.replace(" hits ", " live_hits ")


@query("T-06", "J-08", sql=sql("SELECT mmsi, seq, fence_id, event FROM fence_events", "valid", "hits", extra=LIVE_HITS))
def stream_fence_changes(spark, sf):
    """Fences that are switched off and on again in mid-stream."""
    folder = scratch_path(spark, "fence-changes")
    _fence_log(spark, folder)
    span = common.valid(spark, sf).agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    at = {n: F.timestamp_micros(F.lit(span["a"] + (span["b"] - span["a"]) * n // 10)) for n in (4, 7)}

    def change(session: SparkSession, batch_id: int) -> None:
        if batch_id == 1:  # ahead of the fixes of that time; a change that is appended twice is still one change
            switched = reference.fences(session).where(F.col("id").isin(*SWITCHED))
            for tenth, active in ((4, False), (7, True)):
                switched.withColumns({"is_active": F.lit(active), "changed_at": at[tenth]}).write.mode("append").parquet(f"{folder}/fences")

    return _watched(spark, sf, folder, change)


@query("T-11", sql=sql(f"""
SELECT mmsi, epoch_ms(prev_ts) AS lost_ms FROM enriched WHERE dt > {int(SILENCE_GAP * 60_000)}
UNION ALL SELECT mmsi, epoch_ms(max(ts)) FROM valid GROUP BY mmsi""", "enriched"))
def stream_signal_lost(spark, sf):
    """Timers on event time: a silence is reported once the watermark has passed it."""
    session = job.stream_session(spark)
    lost = sessions.silence_stream(valid_stream(session, sf), SILENCE_GAP, job.LATENESS)
    return ended(collected(lost, spark, "silence")).where("NOT late").select("mmsi", F.unix_millis("lost_at").alias("lost_ms"))


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    session = job.stream_session(spark)
    found = sessions.session_tracks(valid_stream(session, sf), TRACK_GAP, job.LATENESS)
    return ended(collected(found, spark, "sessions"))


@query("W-07", "T-14", sql=sql("""
SELECT mmsi, epoch_ms(track_start) AS track_start_ms, epoch_ms(max(ts)) AS track_end_ms, count(*) AS points, round(sum(leg), 5) AS distance_nm,
  round(avg(speed), 6) AS avg_speed, max(speed) AS max_speed FROM tracked GROUP BY mmsi, track_start""", "enriched", extra=TRACKED))
def stream_session_tracks(spark, sf):
    """The tracks of the batch query, from a stream."""
    return _tracks(spark, sf).where("NOT late").select(
        "mmsi", *common.millis("track_start", "track_end"), "points", common.near(F.col("distance_nm"), 5).alias("distance_nm"),
        *common.rounded("avg_speed"), "max_speed",
    )


@query("W-06", "J-04", sql=sql("""
SELECT epoch_ms(window_start) AS window_start_ms, mmsi_a, mmsi_b, round(distance_nm, 6) AS distance_nm FROM pairs""", "valid", extra=PAIRS))
def stream_proximity(spark, sf):
    """Pairs of every sliding window, in which a fix counts however late it comes."""
    session = job.stream_session(spark)
    folder = scratch_path(spark, "proximity")
    pairs = windows.PairWindows(folder)
    finish(job.run_batches(ended(valid_stream(session, sf)), pairs.write, f"{folder}/checkpoint"))
    return pairs.read(spark).select(
        *common.millis("window_start"), "mmsi_a", "mmsi_b", common.near(F.col("distance_nm")).alias("distance_nm")
    )


@query("W-05", "T-08", sql=sql("""
SELECT mmsi, epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_ms, count(speed) AS n, round(var_samp(speed), 4) AS speed_variance
FROM valid GROUP BY mmsi, time_bucket(INTERVAL 5 MINUTE, ts)
HAVING max(speed) > 1.5 * CASE max(vessel_type) WHEN 'PASSENGER' THEN 35e0 WHEN 'TANKER' THEN 20e0 ELSE 25e0 END OR var_samp(speed) > 400""", "valid"))
def stream_erratic_speed(spark, sf):
    """Tumbling windows as mergeable states, in which a fix counts however late it comes."""
    session, folder = job.stream_session(spark), scratch_path(spark, "speed-windows")
    rows = enrich.with_inferred_type(ended(valid_stream(session, sf)))
    sink = job.RollupSink(f"{folder}/states", rollups.SPEED_WINDOWS)
    finish(job.run_rollup(rows, sink, f"{folder}/checkpoint"))
    done = detect.erratic_windows(sink.read(spark))
    return done.select(
        "mmsi", F.unix_millis("window_start").alias("window_ms"), "n", common.near(F.col("speed_variance"), 4).alias("speed_variance")
    )


@query("J-01", "S-01", sql=sql("""
SELECT p.seq, p.mmsi, coalesce(v.vessel_type, p.vessel_type) AS vessel_type, coalesce(v.flag_state, 'ID') AS flag FROM valid p LEFT JOIN vessels v ON p.mmsi = v.mmsi""", "valid", "vessels"))
def stream_master_join(spark, sf):
    """Stream-static join to the vessel master."""
    session = job.stream_session(spark)
    rows = enrich.with_master(ended(valid_stream(session, sf)), lenses.vessels(session, sf))
    return collected(rows.select("seq", "mmsi", "vessel_type", "flag"), spark, "master").drop("batch_id")


#: Records of a segment of a topic, and segments of a poll.
POLL_RECORDS, POLL_SEGMENTS = 100_000, 2
#: A backlog is taken in so many polls, as long as a poll has no more than so many segments.
BACKLOG_POLLS, MOST_SEGMENTS = 5, 20


def poll_segments(waiting: int) -> int:
    """Segments of a poll when so many wait: a long backlog takes larger polls, so their fixed cost does not grow with it."""
    return min(max(POLL_SEGMENTS, -(-waiting // BACKLOG_POLLS)), MOST_SEGMENTS)


def _persisted(spark: SparkSession, topic: str, rows: DataFrame) -> job.PersistenceSinks:
    """Publish rows as a topic of JSON texts, every other one encoded twice, and run the topic's persistence job on it.

    The job takes some segments a poll, and every segment is delivered twice, by a restart without its checkpoint.
    """
    session, folder = job.stream_session(spark), scratch_path(spark, topic)
    names = job.PERSISTED[topic][2]
    shape = rows.select(*names)
    twice = F.concat(F.lit('"'), F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    def texts(ordered: DataFrame) -> DataFrame:
        once = ordered.select(wire.wire_value(ordered, names).alias("value"), "seq")
        return once.select(F.when(F.pmod(F.xxhash64("seq"), F.lit(2)) == 0, twice).otherwise(F.col("value")).alias("value"))

    files.write_segments(rows, topic, f"{folder}/topics", POLL_RECORDS, ("ts", "seq"), texts)
    waiting = sum(n.startswith("part-") for n in children(spark, f"{folder}/topics/{topic}"))
    sinks = job.persistence_sinks(session, topic, folder, shape)
    for checkpoint in ("checkpoint", "checkpoint-again"):
        messages = files.topic(session, topic, directory=f"{folder}/topics", files_per_trigger=poll_segments(waiting))
        finish(job.run_persistence(job.consumed(messages, topic, dict(shape.dtypes)), sinks, f"{folder}/{checkpoint}"))
    return job.persistence_sinks(spark, topic, folder, shape)


@query("S-02", "S-12", "S-13", "K-05", "K-08", "K-12", sql=sql("""
SELECT grid_id, round(arg_max(temperature, (ts, seq)), 6) AS temperature, arg_max(wind_speed, (ts, seq)) AS wind_speed, epoch_ms(max(ts)) AS ts_ms,
  count(*) AS history_rows FROM weather GROUP BY grid_id""", "weather"))
def stream_persist_weather(spark, sf):
    """Current state and history of the weather topic."""
    sinks = _persisted(spark, "weather", lenses.weather(spark, sf))
    held = spark.read.parquet(f"{sinks.folder}/weather_history").groupBy("grid_id").agg(F.count(F.lit(1)).alias("history_rows"))
    rows = sinks.latest(spark).join(held, "grid_id")
    return rows.select("grid_id", *common.rounded("temperature"), "wind_speed", *common.millis("ts"), "history_rows")


@query("S-02", "S-12", "S-13", "K-06", "K-08", "K-12", sql=sql("""
SELECT operation_id, port_id, status, 'B' || (seq % 12) AS berth_number, epoch_ms(departure_time) AS departure_ms, epoch_ms(ts) AS ts_ms, 2 AS history_rows FROM operations""", "operations"))
def stream_persist_port_operations(spark, sf):
    """Announced first, then as it happened; the history has both messages."""
    rows = writes.operation_messages(spark, sf)
    sinks = _persisted(spark, "port_operations", rows[0].unionByName(rows[1]))
    held = spark.read.parquet(f"{sinks.folder}/port_operations_history").groupBy("operation_id").agg(F.count(F.lit(1)).alias("history_rows"))
    return sinks.latest(spark).join(held, "operation_id").select(
        "operation_id", "port_id", "status", "berth_number", F.unix_millis("departure_time").alias("departure_ms"),
        *common.millis("ts"), "history_rows",
    )


@query("S-02", "S-12", "S-13", "K-07", "K-08", "K-12", sql=sql("""
SELECT sha256(alert_type || '|' || mmsi || '|' || epoch_us(ts) || '|' || seq) AS alert_id, alert_type, severity, mmsi, 2 AS history_rows FROM alerts""", "alerts"))
def stream_persist_alerts(spark, sf):
    """Alerts inserted once by their id, though every one is sent again a minute later; the history has both messages."""
    rows = common.alerts(spark, sf)
    again = rows.withColumns({"severity": F.lit("LATER"), "ts": F.timestamp_micros(F.unix_micros("ts") + 60_000_000)})
    sinks = _persisted(spark, "alerts", rows.unionByName(again))
    held = spark.read.parquet(f"{sinks.folder}/alerts_history").groupBy("alert_id").agg(F.count(F.lit(1)).alias("history_rows"))
    return sinks.latest(spark).join(held, "alert_id").select("alert_id", "alert_type", "severity", "mmsi", "history_rows")


@query("U-01", "X-01", "T-11", "T-13", sql=sql(f"""
SELECT 'EXCESSIVE_SPEED' AS alert_type, mmsi, seq, epoch_ms(ts) AS ts_ms FROM checks WHERE is_fast
UNION ALL SELECT 'SUDDEN_STOP', mmsi, seq, epoch_ms(ts) FROM checks WHERE is_stop
UNION ALL SELECT 'IMPOSSIBLE_ACCELERATION', mmsi, seq, epoch_ms(ts) FROM checks WHERE is_jump
UNION ALL SELECT 'COLLISION_RISK', mmsi_a, mmsi_b, epoch_ms(window_start) FROM risks WHERE tcpa < 600
UNION ALL SELECT 'SIGNAL_LOST', mmsi, seq, epoch_ms(ts) FROM enriched WHERE dt > {int(SILENCE_GAP * 60_000)}
UNION ALL SELECT CASE WHEN event = 'ENTRY' AND geofence_type = 'RESTRICTED' THEN 'RESTRICTED_AREA_ENTRY' WHEN event = 'ENTRY' THEN 'GEOFENCE_ENTRY' ELSE 'GEOFENCE_EXIT' END, e.mmsi, e.seq, epoch_ms(v.ts)
  FROM fence_events e JOIN valid v USING (mmsi, seq) JOIN fences USING (fence_id) WHERE CASE event WHEN 'ENTRY' THEN alert_on_entry ELSE alert_on_exit END""",
    "checks", "hits", "fences", extra=PAIRS + ",\n" + EVENTS))
def stream_all_alerts(spark, sf):
    """Every detector on the stream, row by row: vessels in one job, pairs in another, side by side."""
    session, folder = job.stream_session(spark), scratch_path(spark, "all-alerts")
    _fence_log(spark, folder)
    watch = fences.FenceWatch.at(session, f"{folder}/watch", lambda s: s.read.parquet(f"{folder}/fences"), common.slice_of(spark, sf))
    single, pairs = alerts.MovementAlerts(f"{folder}/single", SILENCE_GAP, watch), alerts.CollisionAlerts(f"{folder}/pairs")
    positions = valid_stream(session, sf)
    started = [
        job.run_batches(state.enriched_stream(ended(positions)), single.write, f"{folder}/single-checkpoint"),
        closed_windows(positions, pairs, f"{folder}/pairs-checkpoint"),
    ]
    for one in started:
        finish(one)
    both = [sink.alerts(spark).select("alert_type", "mmsi", "seq", *common.millis("ts")) for sink in (single, pairs)]
    return both[0].unionByName(both[1])


@query("T-13", "W-06", sql=CATALOG["collision_alerts"].sql)
def stream_collision_alerts(spark, sf):
    """At most one collision alert per pair in five minutes, by a clock that goes from batch to batch."""
    session, folder = job.stream_session(spark), scratch_path(spark, "collisions")
    clock = alerts.Clock.at(session, f"{folder}/clock", ("mmsi_a", "mmsi_b"), "window_start", ("tcpa_seconds",), seconds=common.slice_of(spark, sf))
    sinks = alerts.CollisionAlerts(folder, clock)
    finish(closed_windows(valid_stream(session, sf), sinks, f"{folder}/checkpoint"))
    return sinks.alerts(spark).select(
        F.get("involved_mmsis", F.lit(0)).alias("mmsi_a"), F.get("involved_mmsis", F.lit(1)).alias("mmsi_b"), F.unix_millis("ts").alias("window_start_ms"),
    )


@query("W-03", "W-04", sql=sql("SELECT seq, mmsi, alert_type, severity FROM alerts", "alerts"))
def stream_restart_from_tables(spark, sf):
    """Half of the stream, then the rest by a job that lost its checkpoint and starts from the stored tables."""
    session, folder = job.stream_session(spark), scratch_path(spark, "restart")
    rows = common.valid_rows(lenses.positions(spark, sf))
    middle = rows.agg(F.expr("min(unix_micros(ts)) + (max(unix_micros(ts)) - min(unix_micros(ts))) div 2").alias("us")).first()["us"]
    first = slices_stream(session, in_slices(session, rows.where(F.unix_micros("ts") < middle)))
    rest = slices_stream(session, in_slices(session, rows.where(F.unix_micros("ts") >= middle)))
    before = collected(state.enriched_stream(first), spark, "restart-first")
    stored = before.drop("batch_id")
    raised = job.alerts_of(stored)
    initial = stored_table(state.initial_state(stored, raised), "initial")
    after = collected(state.enriched_stream(rest, initial=session.read.schema(initial.schema).parquet(*initial.inputFiles())), spark, "restart-rest")
    both = raised.unionByName(job.alerts_of(after.drop("batch_id")))
    return both.select("seq", "mmsi", "alert_type", "severity")


@query("K-10", "W-03", sql=sql("""
SELECT mmsi, speed, epoch_ms(ts) AS ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, seq DESC) AS r FROM valid)
WHERE r = 1 AND epoch_ms((SELECT max(ts) FROM valid)) - epoch_ms(ts) < 300000""", "valid"))
def stream_live_positions(spark, sf):
    """Latest values with a life of five minutes, kept as state and read from the state store."""
    session, folder = job.stream_session(spark), scratch_path(spark, "live")
    rows = common.valid_rows(lenses.positions(spark, sf))
    value = "speed double"
    held = state.latest_stream(slices_stream(session, in_slices(session, rows)), value, tables.VALUE_SECONDS["positions"])
    finish(job.run_batches(held, lambda batch, batch_id: batch.write.format("noop").mode("overwrite").save(), f"{folder}/checkpoint"))
    return state.live_values(session, f"{folder}/checkpoint", value).select("mmsi", "speed", F.expr("ts_us div 1000").alias("ts_ms"))
