"""Batch and stream give the same rows, over many micro-batches, restarts and late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fairlead.operators import detect, enrich, rollups, tables, throttle
from fairlead.plans import common, lenses, streams
from fairlead.session import scratch_path
from fairlead.sources import files
from fairlead.streaming import fences, job, sessions, state

SF_DIR = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
FIX = (
    "mmsi long, vessel_name string, imo string, call_sign string, latitude double, longitude double, speed double, "
    "course double, heading int, navigation_status int, status string, ts timestamp, seq long, source string"
)


@pytest.fixture(scope="module")
def split_events(spark):
    """The events table cut into several files in time order."""
    folder = scratch_path(spark, "split-events")
    rows = lenses.table(spark, SF_DIR, "events")
    for i in range(5):
        rows.where(F.expr(f"event_id * 5 div 1000 = {i}")).coalesce(1).write.parquet(f"{folder}/part={i}")
    return folder


def stream_of(session, folder, parts="part=*"):
    schema = session.read.parquet(f"{folder}/part=0").schema
    rows = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{parts}")
    return job.valid_positions(lenses.positions_from_events(rows), F.lit(None).cast("timestamp"), check_age=False)


def test_many_batches_with_a_restart(spark, split_events):
    session = job.stream_session(spark)
    folder = scratch_path(spark, "job")
    shape = job.as_current(common.enriched(spark, SF_DIR)).schema
    current = tables.CurrentTable(session, f"{folder}/current", tables.POSITION_RULE, shape)
    sinks = job.PositionSinks(folder, current)
    written = []

    def fail_at_two(rows, batch_id):
        sinks.write(rows, batch_id)
        written.append(batch_id)
        if batch_id == 2 and written.count(2) == 1:
            raise RuntimeError("sink went away after writing")

    rows = state.enriched_stream(stream_of(session, split_events))
    failed = job.run_batches(rows, fail_at_two, f"{folder}/checkpoint")
    with pytest.raises(Exception, match="sink went away"):
        failed.awaitTermination()
    streams.finish(job.run_batches(rows, fail_at_two, f"{folder}/checkpoint"))
    assert written.count(2) == 2 and len(set(written)) >= 5

    batch = common.enriched(spark, SF_DIR)
    stored = spark.read.parquet(f"{folder}/positions_history")
    columns = ["seq", "mmsi", "distance_from_previous", "time_since_last_update"]
    assert stored.select(columns).exceptAll(batch.select(columns)).count() == 0
    assert stored.count() == batch.count()
    passed = throttle.throttled(detect.first_check(batch), seconds=600).select("seq", "alert_type")
    alerts = spark.read.parquet(f"{folder}/alerts_history").select("seq", "alert_type")
    assert alerts.exceptAll(passed).count() == 0 and passed.exceptAll(alerts).count() == 0
    assert current.read().count() == batch.select("mmsi").distinct().count()


def write_fixes(spark, folder, part, rows):
    data = [
        (1, "A", None, None, 0.0, lon, v, 0.0, None, 0, "x", T0 + dt.timedelta(seconds=s), seq, "t")
        for seq, s, lon, v in rows
    ]
    spark.createDataFrame(data, FIX).coalesce(1).write.parquet(f"{folder}/part={part}")


def test_late_fix_finds_its_previous_and_leaves_the_newest(spark):
    session, folder = job.stream_session(spark), scratch_path(spark, "late")
    write_fixes(spark, folder, 0, [(1, 0, 0.0, 5.0), (2, 60, 1.0, 5.0)])
    write_fixes(spark, folder, 1, [(3, 30, 0.5, 99.0), (4, 120, 2.0, 5.0), (5, -9000, 2.0, 5.0)])
    rows = session.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    done = streams.collected(state.enriched_stream(rows).select("seq", "time_since_last_update", "alert_type"), spark, "late-out").collect()
    assert {r.seq: r.time_since_last_update for r in done} == {1: None, 2: 60_000, 3: 30_000, 4: 60_000, 5: None}
    assert {r.seq for r in done if r.alert_type == detect.EXCESSIVE} == {3}


class Flaky(job.PositionSinks):
    """Sinks of which one fails in the second batch, once."""

    failures = [1]

    def tasks(self, rows, batch_id):
        found = super().tasks(rows, batch_id)

        def fail():
            if batch_id == 1 and self.failures:
                self.failures.pop()
                raise RuntimeError("one sink went away")

        return {**found, "flaky": fail}


def test_a_failing_sink_leaves_no_trace_for_readers(spark, split_events):
    session, folder = job.stream_session(spark), scratch_path(spark, "flaky")
    shape = job.as_current(common.enriched(spark, SF_DIR)).schema
    sinks = Flaky(folder, tables.CurrentTable(session, f"{folder}/current", tables.POSITION_RULE, shape))
    rows = state.enriched_stream(stream_of(session, split_events))
    failed = job.run_batches(rows, sinks.write, f"{folder}/checkpoint")
    with pytest.raises(Exception, match="one sink went away"):
        failed.awaitTermination()
    # The other sinks have written the second batch, but nobody sees it.
    assert spark.read.parquet(f"{folder}/positions_history").select("batch_id").distinct().count() == 2
    first = sinks.history(spark, "positions_history")
    assert sinks.visible(spark) == 0 and {r.batch_id for r in first.select("batch_id").distinct().collect()} == {0}
    assert sinks.topic(spark, "vessel-positions").count() == first.count()
    assert sinks.latest(spark).count() == first.select("mmsi").distinct().count()
    streams.finish(job.run_batches(rows, sinks.write, f"{folder}/checkpoint"))
    batch = common.enriched(spark, SF_DIR)
    assert sinks.history(spark, "positions_history").count() == sinks.topic(spark, "vessel-positions").count() == batch.count()
    assert sinks.latest(spark).count() == batch.select("mmsi").distinct().count()


def test_concurrent_jobs_all_end_before_the_first_error(spark):
    done = []

    def fail():
        raise ValueError("first")

    with pytest.raises(ValueError, match="first"):
        job.together(spark, {"a": fail, "b": lambda: done.append(spark.range(1000).count()), "c": lambda: done.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))})
    assert sorted(map(str, done)) == ["1000", "c"]


def test_tracks_of_shuffled_and_late_fixes(spark):
    """Slices overlap by minutes, one late fix bridges two runs, and what is too late is told, not lost."""
    import random

    session, folder, rng = job.stream_session(spark), scratch_path(spark, "sessions"), random.Random(5)
    fixes, t = [], 0
    for seq in range(120):
        t += rng.choice([30, 60, 170, 200, 400])
        fixes.append((seq, t, seq / 50, float(seq % 17)))
    order = sorted(fixes, key=lambda f: f[1] + rng.randint(0, 500))
    for i in range(6):
        write_fixes(spark, folder, i, order[20 * i : 20 * i + 20])
    write_fixes(spark, folder, 6, [(900, 10**6, 0.0, 1.0)])
    write_fixes(spark, folder, 7, [(901, 50, 0.0, 1.0), (902, 10**6 + 10, 0.0, 1.0)])
    write_fixes(spark, folder, 8, [(903, 2 * 10**6, 0.0, 1.0)])
    rows = session.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    done = streams.collected(sessions.session_tracks(rows, 3.0, "600 seconds"), spark, "sessions-out")
    late = {r.seq for r in done.where("late").collect()}
    kept = [f for f in [*fixes, (900, 10**6, 0.0, 1.0), (902, 10**6 + 10, 0.0, 1.0)] if f[0] not in late]
    assert 901 in late
    given = spark.createDataFrame([(1, "A", None, None, 0.0, lon, v, 0.0, None, 0, "x", T0 + dt.timedelta(seconds=s), seq, "t") for seq, s, lon, v in kept], FIX)
    from fairlead.operators import tracks

    want = tracks.track_summary(tracks.with_track(given, 3.0, 600.0))
    columns = ["track_start", "track_end", "points", "max_speed"]
    values = lambda rows: sorted((*[r[c] for c in columns], round(r.distance_nm, 9), round(r.avg_speed, 9)) for r in rows)
    found = done.where("NOT late")
    assert values(found.where("track_start < '2024-01-20'").collect()) == values(want.collect())
    # Every fix but the one that ends the stream is a point or a late row.
    assert sum(r.points for r in found.collect()) + len(late) == 123


def test_fence_changes_do_not_depend_on_the_batches(spark):
    from fairlead.operators import spatial
    from fairlead.sources import reference

    rows = common.valid(spark, SF_DIR).select("mmsi", "vessel_name", "speed", "latitude", "longitude", "ts", "seq")
    log = reference.fences(spark).withColumn("changed_at", F.lit(None).cast("timestamp"))
    off = reference.fences(spark).where("id < 4").withColumns({"is_active": F.lit(False), "changed_at": F.lit(T0 + dt.timedelta(minutes=20))})
    log = log.unionByName(off).unionByName(off)  # appended twice by a replay
    want = spatial.fence_events(rows, spatial.fence_versions(log)).select("mmsi", "seq", "fence_id", "event")
    plain = spatial.fence_events(rows, reference.fences(spark)).select("mmsi", "seq", "fence_id", "event")
    assert want.exceptAll(plain).count() > 0
    for cuts in ([25], [10, 19, 20, 40]):
        folder = scratch_path(spark, "watch")
        watch = fences.FenceWatch.at(spark, folder, lambda s: log)
        edges = [T0 - dt.timedelta(days=9), *[T0 + dt.timedelta(minutes=c) for c in cuts], T0 + dt.timedelta(days=9)]
        for i in range(len(edges) - 1):
            batch = rows.where((F.col("ts") >= edges[i]) & (F.col("ts") < edges[i + 1]))
            watch.write(batch, i)
            watch.write(batch, i)  # delivered again
        got = watch.events(spark).select("mmsi", "seq", "fence_id", "event")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        assert watch.late(spark).count() == 0
        early = rows.where(F.col("ts") < edges[1]).limit(7)
        watch.write(early, len(edges))
        assert watch.late(spark).count() == 7


def test_fixes_of_one_file_meet_fences_in_many_tasks(spark, monkeypatch):
    from fairlead.operators import spatial
    from fairlead.sources import reference

    folder = scratch_path(spark, "one-file")
    common.valid(spark, SF_DIR).select("mmsi", "latitude", "longitude", "ts", "seq").coalesce(1).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    assert rows.rdd.getNumPartitions() == 1
    tasks, folds = [], []
    meet, read = spatial.with_fences_inside, tables.CurrentTable.read
    monkeypatch.setattr(spatial, "with_fences_inside", lambda rows, *rest: tasks.append(len({r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()})) or meet(rows, *rest))
    watch = fences.FenceWatch.at(spark, folder, lambda s: reference.fences(s).withColumn("changed_at", F.lit(None).cast("timestamp")))
    monkeypatch.setattr(tables.CurrentTable, "read", lambda self, **upto: folds.append(1) or read(self, **upto))
    watch.write(rows, 0)
    assert tasks == [int(spark.conf.get("spark.sql.shuffle.partitions"))] and len(folds) == 1
    monkeypatch.undo()
    want = spatial.fence_events(common.valid(spark, SF_DIR), reference.fences(spark)).select("mmsi", "seq", "fence_id", "event")
    got = watch.events(spark).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 20


def test_late_fixes_count_in_pair_windows(spark):
    from fairlead.operators import proximity
    from fairlead.streaming import windows

    rows = [(1 + i % 5, 0.001 * (i % 3), 0.002 * (i % 4), 5.0, 90.0, T0 + dt.timedelta(seconds=7 * (i // 5)), i) for i in range(150)]
    given = spark.createDataFrame(rows, "mmsi long, latitude double, longitude double, speed double, course double, ts timestamp, seq long")
    want = proximity.close_pairs(proximity.window_fixes(given))
    folder = scratch_path(spark, "pair-windows")
    pairs = windows.PairWindows(folder)
    for i in (3, 0, 2, 1, 1):  # hours out of order, the last batch delivered twice
        pairs.write(given.where((F.col("seq") * 4 / 150).cast("int") == i), {3: 0, 0: 1, 2: 2, 1: 3}[i])
    got = pairs.read(spark).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 20


def test_pair_windows_store_fixes_and_not_pairs(spark):
    from fairlead.streaming import windows

    rows = [(1 + i % 60, 0.0, 0.0001 * (i % 60), 5.0, 90.0, T0 + dt.timedelta(seconds=i // 60), i) for i in range(240)]
    given = spark.createDataFrame(rows, "mmsi long, latitude double, longitude double, speed double, course double, ts timestamp, seq long")
    folder = scratch_path(spark, "dense-windows")
    pairs = windows.PairWindows(folder)
    for i in range(2):
        pairs.write(given.where(F.col("seq") % 2 == i), i)
    names = spark.read.option("recursiveFileLookup", "true").format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path").collect()
    stored = sum(spark.read.parquet(r.path).count() for r in names)
    assert 0 < stored <= len(rows)
    assert pairs.read(spark).count() == 3 * 60 * 59 // 2


@pytest.mark.parametrize("width, slide", [("30 seconds", "10 seconds"), ("25 seconds", "10 seconds"), ("10 seconds", "10 seconds"), ("4 seconds", "6 seconds")])
def test_spans_of_windows_are_the_windows(spark, monkeypatch, width, slide):
    import random

    from fairlead.operators import proximity
    from fairlead.streaming import windows

    monkeypatch.setattr(windows, "STRETCH", 3)
    rng = random.Random(4)
    start = dt.datetime(1969, 12, 31, 23, 58)  # panes below and above zero
    rows = [(rng.randrange(9), rng.choice([0.0, 0.004, None]), 0.003 * rng.randrange(4), 5.0, 90.0, start + dt.timedelta(microseconds=rng.randrange(240) * 10**6 - rng.randrange(2)), i) for i in range(300)]
    given = spark.createDataFrame(rows, "mmsi long, latitude double, longitude double, speed double, course double, ts timestamp, seq long")
    if slide == "6 seconds":  # windows with gaps between them, which Spark's own windows do not know
        micros = F.unix_micros("ts")
        of = given.withColumn("at", F.floor((micros - F.pmod(micros, F.lit(6_000_000))) / 6_000_000) * 6_000_000).where(micros - F.col("at") < 4_000_000)
        latest = of.groupBy(F.timestamp_micros("at").alias("window_start"), "mmsi").agg(F.max_by(F.struct("latitude", "longitude", "speed", "course", "ts"), F.struct("ts", "seq")).alias("fix"))
        want = proximity.close_pairs(latest.select("window_start", "mmsi", "fix.*"), load=3)
    else:
        want = proximity.close_pairs(proximity.window_fixes(given, width, slide), load=3)
    pairs = windows.PairWindows(scratch_path(spark, "span-windows"), width, slide)
    for i in range(3):
        pairs.write(given.where(F.col("seq") % 3 == i), i)
    got = pairs.read(spark).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 20
    spans = pairs._spans(pairs._stored(spark))
    divided = proximity.close_spans(spans, load=2)
    assert divided.count() == want.count()


def test_a_clock_throttles_over_batches(spark):
    import random

    from fairlead.streaming import alerts

    rng = random.Random(1)
    rows = [(1 + rng.randrange(3), 9, T0 + dt.timedelta(seconds=rng.randrange(5000)), float(i)) for i in range(200)]
    given = spark.createDataFrame(rows, "mmsi_a long, mmsi_b long, window_start timestamp, tcpa_seconds double")
    want = throttle.throttled(given, ["mmsi_a", "mmsi_b"], ts="window_start", order=["tcpa_seconds"])
    clock = alerts.Clock.at(spark, scratch_path(spark, "clock"), ("mmsi_a", "mmsi_b"), "window_start", ("tcpa_seconds",))
    found = []
    for i in range(5):
        batch = given.where((F.col("window_start") >= T0 + dt.timedelta(seconds=1000 * i)) & (F.col("window_start") < T0 + dt.timedelta(seconds=1000 * i + 1000)))
        passed = clock.passed(batch, i)
        found += passed.collect()
        clock.moved(passed, i)
    assert sorted(found) == sorted(want.collect()) and len(found) > 10


@pytest.mark.parametrize("throttled", [False, True])
def test_collision_alerts_store_fixes_and_not_pairs(spark, throttled):
    """Over many batches, one of them delivered twice and one that nobody sees, as over all windows at once."""
    from fairlead.operators import proximity
    from fairlead.streaming import alerts

    rows = [(1 + i % 40, 0.0, 0.0002 * (i * 7 % 40), float(i % 11), float(i * 37 % 360), T0 + dt.timedelta(seconds=i // 40 * 25), i) for i in range(800)]
    given = spark.createDataFrame(rows, "mmsi long, latitude double, longitude double, speed double, course double, ts timestamp, seq long")
    fixes = proximity.window_fixes(given)
    risks = proximity.collision_risk(proximity.close_pairs(fixes), within_seconds=proximity.COLLISION_SECONDS)
    if throttled:
        risks = throttle.throttled(risks, ["mmsi_a", "mmsi_b"], ts="window_start", order=["tcpa_seconds"])
    want = proximity.collision_alerts(risks)
    folder = scratch_path(spark, "collisions")
    clock = alerts.Clock.at(spark, f"{folder}/clock", ("mmsi_a", "mmsi_b"), "window_start", ("tcpa_seconds",)) if throttled else None
    sink = alerts.CollisionAlerts(folder, clock)
    for i, start in ((0, -30), (1, 100), (1, 100), (2, 250)):
        inside = F.col("window_start") >= T0 + dt.timedelta(seconds=start)
        sink.write(fixes.where(inside & (F.col("window_start") < T0 + dt.timedelta(seconds={0: 100, 1: 250, 2: 10**6}[i]))), i)
    sink.tasks(fixes, 3)["collision"]()  # not shown yet
    got = sink.alerts(spark).select(want.columns)
    texts = [F.to_json("details").alias(c) if c == "details" else c for c in want.columns]
    got, want = got.select(texts), want.select(texts)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 500
    names = spark.read.option("recursiveFileLookup", "true").format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path").collect()
    stored = sum(spark.read.parquet(r.path).count() for r in names)
    assert 0 < stored <= 2 * fixes.count()


def test_pairs_of_the_last_seconds_raise_alerts(spark, monkeypatch):
    """Windows that are open when the stream ends are closed by the end marker."""
    from fairlead.operators import proximity

    rows = [(m, 0.0, 0.5 * pair + 0.004 * side + 10.0 * m * (s < 1000), 6.0, 90.0 if side == 0 else 270.0, T0 + dt.timedelta(seconds=s), 100 * s + m)
            for s in (*range(0, 1000, 50), 1001, 1003) for pair in range(3) for side in (0, 1) for m in (1 + 2 * pair + side,)]
    given = spark.createDataFrame(rows, "mmsi long, latitude double, longitude double, speed double, course double, ts timestamp, seq long")
    want = proximity.collision_risk(proximity.close_pairs(proximity.window_fixes(given)), within_seconds=proximity.COLLISION_SECONDS)
    want = throttle.throttled(want, ["mmsi_a", "mmsi_b"], ts="window_start", order=["tcpa_seconds"])
    marker = {"mmsi": F.lit(streams.END).cast("long")}
    monkeypatch.setattr(streams, "valid_stream", lambda session, sf: streams.slices_stream(session, streams.in_slices(session, given, marker)))
    monkeypatch.setattr(common, "slice_of", lambda spark, sf: 600.0)
    got = streams.stream_collision_alerts(spark, SF_DIR).collect()
    assert sorted((r.mmsi_a, r.mmsi_b, r.window_start_ms) for r in got) == sorted((r.mmsi_a, r.mmsi_b, r.ms) for r in want.select("*", F.unix_millis("window_start").alias("ms")).collect())
    assert len(got) == 3


def test_late_rows_count_in_rollups_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(tables, "COMPACT_EVERY", 2)
    session, folder = job.stream_session(spark), scratch_path(spark, "late-rollup")
    times = [0, 10, 4000, 8000, 5, 12_000, 3900]  # the fifth is hours late
    for i, s in enumerate(times):
        write_fixes(spark, folder, i, [(i, s, 0.0, float(i))])
    rows = enrich.with_inferred_type(session.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*"))
    sink = job.RollupSink(f"{folder}-states", rollups.MOVEMENT_HOURLY)
    streams.finish(job.run_rollup(rows, sink, f"{folder}-checkpoint"))
    found = {(r.hour - T0).seconds // 3600: (r.position_count, r.max_speed) for r in sink.read(spark).collect()}
    assert found == {0: (3, 4.0), 1: (2, 6.0), 2: (1, 3.0), 3: (1, 5.0)}
    assert len(sink._done(spark, "batches")) <= 4 and len(sink._done(spark, "bases")) <= 2


def test_event_time_falls_back_to_arrival(spark):
    rows = spark.createDataFrame([(1, None, T0), (2, T0, None), (3, None, None)], "i int, ts timestamp, arrived timestamp")
    assert sorted(r.i for r in job.event_time(rows).collect()) == [1, 2]


def test_batch_enrichment_equals_plain_window(spark):
    from pyspark.sql import Window

    rows = common.valid(spark, SF_DIR)
    w = Window.partitionBy("mmsi").orderBy("ts", "seq")
    want = rows.select("seq", (F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(w))).alias("t"))
    for seconds in (30, 600, 10**7):
        got = enrich.with_movement(rows, seconds).select("seq", F.col("time_since_last_update").alias("t"))
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_a_step_is_called_by_bucket_and_not_by_vessel(spark):
    """Hundreds of vessels, one without a number, in as many states as there are buckets at most."""
    from fairlead.streaming import buckets

    session, folder = job.stream_session(spark), scratch_path(spark, "buckets")
    for part in (0, 1):
        rows = [(m if m else None, 2**60 + m if m % 7 else None, T0 + dt.timedelta(seconds=60 * part + m % 5), float(m + part)) for m in range(700)]
        spark.createDataFrame(rows, "mmsi long, seq long, ts timestamp, speed double").coalesce(1).write.parquet(f"{folder}/part={part}")
    given = session.readStream.schema("mmsi long, seq long, ts timestamp, speed double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    held = state.latest_stream(given, "speed double", 3600)
    streams.finish(job.run_batches(held, lambda batch, batch_id: batch.write.format("noop").mode("overwrite").save(), f"{folder}/checkpoint"))
    found = {(r.mmsi, r.seq, r.speed) for r in state.live_values(session, f"{folder}/checkpoint", "speed double").collect()}
    assert found == {(m if m else None, 2**60 + m if m % 7 else None, m + 1.0) for m in range(700)}
    stored = session.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "latest").load()
    assert stored.count() <= buckets.BUCKETS


def test_a_long_backlog_takes_larger_polls():
    """The number of polls stays the same until a poll has its most segments; a short backlog polls as before."""
    sizes = [streams.poll_segments(n) for n in (1, 6, 10, 24, 100, 2160)]
    assert sizes == [2, 2, 2, 5, 20, 20]


def test_texts_are_made_once_rows_are_in_order(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def text(n):
        made.add(1)
        return str(n)

    rows = spark.range(1000).select((1000 - F.col("id")).alias("n"))
    told = lambda ordered: ordered.select(F.udf(text)("n").alias("value"))
    files.write_segments(rows, "told", str(tmp_path), 10_000, ("n",), told)
    assert [int(r.value) for r in spark.read.text(f"{tmp_path}/told").collect()] == list(range(1, 1001))
    assert made.value == 1000


def test_segments_are_packed_and_polled_in_order(spark, tmp_path):
    """Every segment has its records, a poll takes the oldest, and they take a fraction of their texts."""
    rows = spark.range(3000).select((3000 - F.col("id")).alias("n"))
    text = F.concat(F.lit('{"temperature":"21.5","windSpeed":"12.25","sequence":"'), F.col("n").cast("string"), F.lit('"}'))
    files.write_segments(rows, "packed", str(tmp_path), 200, ("n",), lambda ordered: ordered.select(text.alias("value")))
    segments = [p for p in (tmp_path / "packed").iterdir() if p.name.startswith("part-")]
    told = [r.value for r in spark.read.text(f"{tmp_path}/packed").collect()]
    assert len(segments) >= 15 and sum(p.stat().st_size for p in segments) * 4 < sum(map(len, told))
    seen = []
    polled = files.topic(spark, "packed", directory=str(tmp_path), files_per_trigger=4)
    number = F.get_json_object("value", "$.sequence").cast("int")
    streams.finish(job.run_batches(polled.select(number.alias("n")), lambda rows, i: seen.append(sorted(r.n for r in rows.collect())), f"{tmp_path}/checkpoint"))
    assert len(seen) >= 4 and [n for batch in seen for n in batch] == list(range(1, 3001))
