"""Fences, radius search and close pairs against brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import proximity, spatial
from fairlead.sources import reference

T0 = dt.datetime(2024, 1, 1)


def nm(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_NM * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def positions(spark, points):
    rows = [(i + 1, lat, lon, 10.0, 0.0, T0, i) for i, (lat, lon) in enumerate(points)]
    return spark.createDataFrame(
        rows, "mmsi long, latitude double, longitude double, speed double, course double, ts timestamp, seq long"
    )


def pairs(fixes, **options):
    rows = proximity.close_pairs(fixes.withColumn("window_start", F.lit(T0)), **options).collect()
    found = [(r.mmsi_a, r.mmsi_b) for r in rows]
    assert len(found) == len(set(found))
    return set(found)


def brute(points, limit):
    return {
        (i + 1, j + 1) for i in range(len(points)) for j in range(i + 1, len(points)) if nm(points[i], points[j]) < limit
    }


@pytest.mark.parametrize("centre", [(0.0, 0.0), (-6.1, 106.8), (0.3, 180.0), (75.0, -179.99), (89.97, 40.0), (-89.99, 0.0)])
@pytest.mark.parametrize("limit", [0.5, 5.0])
def test_pairs_equal_brute_force(spark, centre, limit):
    rng = np.random.default_rng(7)
    spread = limit / 60 * 4
    points = []
    for _ in range(150):
        lat = float(np.clip(centre[0] + rng.uniform(-spread, spread), -90, 90))
        wide = spread / max(0.02, math.cos(math.radians(lat)))
        lon = (centre[1] + rng.uniform(-wide, wide) + 180) % 360 - 180
        points.append((lat, float(lon)))
    want = brute(points, limit)
    assert want
    assert pairs(positions(spark, points), near_nm=limit) == want
    assert pairs(positions(spark, points), near_nm=limit, load=4) == want


def test_crowded_cell_is_divided(spark):
    points = [(1.0 + i * 1e-5, 103.0) for i in range(120)]
    assert pairs(positions(spark, points), load=8) == brute(points, 0.5)


def approach(spark, a, b):
    cols = "latitude_a double, longitude_a double, speed_a double, course_a double, latitude_b double, longitude_b double, speed_b double, course_b double"
    df = spark.createDataFrame([(*a, *b)], cols)
    return proximity.with_approach(df).select("tcpa_seconds", "cpa_nm").first()


def test_closest_approach(spark):
    head_on = approach(spark, (0.0, 0.0, 10.0, 90.0), (0.0, 0.4 / 60, 10.0, 270.0))
    assert head_on.tcpa_seconds == pytest.approx(72.0, rel=1e-6) and head_on.cpa_nm == pytest.approx(0.0, abs=1e-6)
    assert approach(spark, (0.0, 0.0, 10.0, 90.0), (0.1, 0.0, 10.0, 90.0)).tcpa_seconds is None
    assert approach(spark, (0.0, 0.0, 10.0, 270.0), (0.0, 0.4 / 60, 10.0, 90.0)).tcpa_seconds < 0
    over_date_line = approach(spark, (0.0, 179.999, 10.0, 90.0), (0.0, -179.999, 10.0, 270.0))
    assert over_date_line.tcpa_seconds == pytest.approx(0.06 / 10 / 2 * 3600 * 2, rel=1e-3)


CONCAVE = [reference.ring((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))]
HOLED = [reference.ring((10, 0), (14, 0), (14, 4), (10, 4)), reference.ring((11, 1), (13, 1), (13, 3), (11, 3))]


def test_point_in_shapes(spark):
    fences = spark.createDataFrame(
        [
            (1, "concave", "PORT", CONCAVE, True, True, True),
            (2, "holed", "PORT", HOLED, True, True, True),
            (3, "off", "PORT", CONCAVE, False, True, True),
        ],
        reference.FENCE_SCHEMA,
    )
    points = [(1.0, 1.0), (3.0, 3.0), (1.0, 3.0), (2.0, 12.0), (0.5, 12.0), (50.0, 50.0)]
    for bound in (1000, 0):
        got = spatial.with_fences_inside(positions(spark, points), fences, max_rows=bound).orderBy("mmsi").collect()
        assert [r.inside for r in got] == [[1], [], [1], [], [2], []]


def test_entry_exit_entry(spark):
    track = [(9.0, 9.0), (1.0, 1.0), (1.5, 1.0), (9.0, 9.0), (1.0, 1.0)]
    rows = [(1, "A", lat, lon, 1.0, T0 + dt.timedelta(minutes=20 * i), i) for i, (lat, lon) in enumerate(track)]
    df = spark.createDataFrame(rows, "mmsi long, vessel_name string, latitude double, longitude double, speed double, ts timestamp, seq long")
    fences = spark.createDataFrame([(1, "c", "RESTRICTED", CONCAVE, True, True, False)], reference.FENCE_SCHEMA)
    for seconds in (600, 10**6):
        events = spatial.fence_events(df, fences, seconds)
        assert [(r.seq, r.event) for r in events.orderBy("seq").collect()] == [(1, "ENTRY"), (3, "EXIT"), (4, "ENTRY")]
    alerts = spatial.fence_alerts(events, fences).collect()
    assert {a.alert_type for a in alerts} == {"RESTRICTED_AREA_ENTRY"} and len(alerts) == 2


@pytest.mark.parametrize("centre", [(0.0, 0.0), (60.0, 179.95), (-89.9, 10.0)])
def test_radius_equals_brute_force(spark, centre):
    rng = np.random.default_rng(11)
    points = []
    for _ in range(400):
        lat = float(np.clip(centre[0] + rng.uniform(-1, 1), -90, 90))
        points.append((lat, float((centre[1] + rng.uniform(-3, 3) + 180) % 360 - 180)))
    got = {r.mmsi for r in spatial.within_radius(positions(spark, points), *centre, 60.0).collect()}
    want = {i + 1 for i, p in enumerate(points) if nm(centre, p) / geo.EARTH_RADIUS_NM * geo.EARTH_RADIUS_KM <= 60.0}
    assert got == want and want


def test_wide_fences_take_few_rows_and_the_date_line_is_no_edge(spark):
    box = lambda west, east, south, north: [reference.ring((west, south), ((west + east) / 2, south), (east, south), (east, north), ((west + east) / 2, north), (west, north))]
    over = [reference.ring((179.0, -1.0), (-179.0, -1.0), (-179.0, 1.0), (179.0, 1.0))]
    rows = [(1, "Ocean", "CUSTOM", box(-130.0, 130.0, -80.0, 80.0), True, True, True), (2, "Line", "CUSTOM", over, True, True, True)]
    fences = spark.createDataFrame(rows, reference.FENCE_SCHEMA)
    assert spatial.fence_rows(fences).count() < 400
    points = [(1, 0.0, 0.0, [1]), (2, 0.5, 179.5, [2]), (3, -0.5, -179.5, [2]), (4, 0.0, 180.0, [2]), (5, 0.0, -180.0, [2]), (6, 0.0, 178.9, []), (7, 79.0, -129.0, [1]), (8, 81.0, 0.0, [])]
    where = spark.createDataFrame([(m, m, a, o) for m, a, o, _ in points], "mmsi long, seq long, latitude double, longitude double")
    for bounds in ({}, {"max_rows": 1}, {"max_edges": 1}):
        found = {r.mmsi: r.inside for r in spatial.with_fences_inside(where, fences, **bounds).collect()}
        assert found == {m: inside for m, _, _, inside in points}


def test_the_approach_is_worked_out_for_pairs_and_not_for_candidates(spark):
    """The course of a vessel has no place in the condition of the join, where every candidate would pay for it."""
    fixes = positions(spark, [(1.0, 2.0), (1.001, 2.0), (1.0, 2.001)]).withColumn("window_start", F.lit(T0))
    found = proximity.collision_alerts(proximity.collision_risk(proximity.close_pairs(fixes)))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join Inner" in line and "latitude_b" in line]
    assert joins and not [line for line in joins if "course" in line]
    # The cheap test of longitudes comes before the distance.
    assert all("_wide" in line for line in joins)
