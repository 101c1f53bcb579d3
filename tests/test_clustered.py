"""Stored tables open only the files that a read needs, and return what a full scan returns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import clustered, reads
from fairlead.plans import common, lenses
from fairlead.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark):
    rows = common.valid_long(spark, SF_DIR)
    held = clustered.KeyedHistory(scratch_path(spark, "keyed"), ("mmsi",), rows.schema)
    held.append(rows.where("seq % 2 = 0"), row_group_bytes=4096)
    held.append(rows.where("seq % 2 = 1"), row_group_bytes=4096)
    return held


def scanned(df) -> dict[str, int]:
    """Metrics of the file scans of a query that is run now, in a plan of its own: a second run of a plan counts no files."""
    df = df.select("*")
    df.collect()
    found: dict[str, int] = {}
    waiting = [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
            continue
        if "Scan" in node.nodeName():
            metrics = node.metrics()
            for name in ("numFiles", "numOutputRows", "numPartitions"):
                if metrics.contains(name):
                    found[name] = found.get(name, 0) + metrics.apply(name).value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.length())]
        if "QueryStage" in node.nodeName():
            waiting.append(node.plan())
    return found


def test_a_vessel_is_read_from_its_folders(spark, history):
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-25"))
    whole = common.valid_long(spark, SF_DIR)
    mmsi = 525_000_005
    got, want = history.between(spark, [mmsi], start, end), reads.vessel_history(whole, mmsi, start, end)
    assert sorted(r.ts for r in got.collect()) == [r.ts for r in want.collect()] and want.count() > 0
    every, own = scanned(history.table(spark)), scanned(got)
    assert 0 < own["numFiles"] <= every["numFiles"] // 10
    assert own["numOutputRows"] < every["numOutputRows"] // 5
    assert "PushedFilters: [IsNotNull(mmsi), EqualTo(mmsi,525000005)" in got._jdf.queryExecution().executedPlan().toString()


def test_the_newest_reading_opens_the_last_months_only(spark):
    rows = lenses.weather(spark, SF_DIR)
    held = clustered.KeyedHistory(scratch_path(spark, "weather"), ("grid_id",), rows.schema, buckets=8)
    held.append(rows)
    for grid in [r.grid_id for r in rows.select("grid_id").distinct().limit(4).collect()] + ["nowhere"]:
        want = [r.seq for r in rows.where(F.col("grid_id") == grid).orderBy(F.desc("ts"), F.desc("seq")).limit(1).collect()]
        found = held.newest(spark, [grid])
        assert [r.seq for r in found.collect()] == want
        if want:
            assert scanned(found)["numFiles"] <= scanned(held.table(spark))["numFiles"] // 40


POLES = [(1, 89.9, 10.0), (2, 89.8, -170.0), (3, -89.95, 0.0), (4, 0.0, 179.95), (5, 0.05, -179.9), (6, 0.0, 0.0)]


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(2)
    rows = POLES + [(10 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(1000 + i, 1.2 + rng.random() / 9, 103.8 + rng.random() / 9) for i in range(200)]
    rows += [(5000, 1.25, 103.85), (5001, 1.25, 103.85), (5002, 90.0, 50.0), (5003, 0.0, 180.0), (5004, 0.0, -180.0)]
    frame = spark.createDataFrame(rows, "mmsi long, latitude double, longitude double")
    held = clustered.PlacedTable(scratch_path(spark, "places"), frame.schema)
    held.write(frame)
    return rows, held


QUESTIONS = [(1, 90.0, 0.0), (2, -90.0, 77.0), (3, 0.0, 180.0), (4, 0.01, -179.99), (5, 1.25, 103.85), (6, 45.0, 45.0), (7, 89.0, -120.0), (8, -60.0, 179.0)]


def brute(rows, lat, lon, k):
    away = [(geo.great_circle_of(lat, lon, b, c, geo.EARTH_RADIUS_KM), a) for a, b, c in rows]
    return sorted(away)[:k]


@pytest.mark.parametrize("k", [1, 12, 1000])
def test_nearest_is_that_of_all_rows(spark, places, k):
    rows, held = places
    for _, lat, lon in QUESTIONS[:: 1 if k == 12 else 3]:
        found = [(r.distance_km, r.mmsi) for r in held.nearest(spark, lat, lon, k).collect()]
        want = brute(rows, lat, lon, k)
        assert [round(d, 6) for d, _ in found] == [round(d, 6) for d, _ in want]
        assert {m for d, m in found if d < want[-1][0] - 1e-6} == {m for d, m in want if d < want[-1][0] - 1e-6}


def test_nearest_of_many_points(spark, places):
    rows, held = places
    points = spark.createDataFrame(QUESTIONS, "point_id long, lat double, lon double")
    found = {}
    for r in held.nearest_join(points, 7).collect():
        found.setdefault(r.point_id, []).append((r["rank"], round(r.distance_km, 6)))
    for i, lat, lon in QUESTIONS:
        assert sorted(found[i]) == [(n + 1, round(d, 6)) for n, (d, _) in enumerate(brute(rows, lat, lon, 7))]


def test_points_among_dense_rows_meet_few_of_them(spark, monkeypatch):
    """A point meets rows in proportion to those it asks for, not all that lie around it."""
    rng, met = random.Random(7), []
    rows = [(i, 1.2 + rng.random() / 9, 103.8 + rng.random() / 9) for i in range(1500)]
    frame = spark.createDataFrame(rows, "mmsi long, latitude double, longitude double")
    held = clustered.PlacedTable(scratch_path(spark, "dense-places"), frame.schema)
    held.write(frame)
    inner = clustered._met

    def counted(*given):
        found = inner(*given)
        met.append(found.count())
        return found

    monkeypatch.setattr(clustered, "_met", counted)
    found = {}
    for r in held.nearest_join(frame.limit(40).selectExpr("mmsi AS point_id", "latitude AS lat", "longitude AS lon"), 5).collect():
        found.setdefault(r.point_id, []).append((r["rank"], round(r.distance_km, 6)))
    assert len(found) == 40 and sum(met) < 40 * 5 * 4 * 16
    for i, got in found.items():
        assert sorted(got) == [(n + 1, round(d, 6)) for n, (d, _) in enumerate(brute(rows, *rows[i][1:], 5))]


def test_far_cells_stay_closed(spark, places):
    _, held = places
    assert scanned(held.within(spark, 1.25, 103.85, 25.0))["numFiles"] <= 9 < scanned(held.table(spark))["numFiles"] // 4


def test_names_by_postings_of_their_words(spark):
    index = clustered.NameIndex(scratch_path(spark, "names"))
    frame = lambda rows: spark.createDataFrame(rows, "mmsi long, name string")
    index.add(frame([(1, "Ever Given"), (2, "MV Ever Green"), (3, "Éclair du Nord"), (4, None), (5, "MV  x")]), 0)
    for _ in range(2):  # a batch that is written again replaces itself
        index.add(frame([(1, "Ever Taken"), (6, "mv mv ever")]), 1)
    index.add(frame([(1, "Ever Given"), (2, None)]), 2)
    match = lambda text: [(r.mmsi, r.name, r.score) for r in index.match(spark, text).collect()]
    assert match("EVER mv given") == [(1, "Ever Given", 2), (6, "mv mv ever", 2), (5, "MV  x", 1)]
    assert match("taken green") == [] and match("") == [] and match("éclair") == [(3, "Éclair du Nord", 1)]
    complete = lambda text: [(r.mmsi, r.name) for r in index.complete(spark, text).collect()]
    assert complete("ever ") == [(1, "Ever Given")] and complete("é") == [(3, "Éclair du Nord")] and complete("m") == [(5, "MV  x"), (6, "mv mv ever")]
    assert len(complete("")) == 4 and complete("zz") == []
    assert {r.word: r.names for r in index.frequencies(spark).collect()}["ever"] == 2
    read = scanned(index.match(spark, "given"))
    assert read["numFiles"] <= 3 < scanned(index._read(spark, "postings"))["numFiles"]
