"""Rule boundaries on hand-written rows."""

import datetime as dt
import math
import operator

import pytest
from pyspark.sql import functions as F

from fairlead.functions import geo, port, times, vessel, weather
from fairlead.operators import detect, enrich, reads, rules, tables, throttle, tracks, validate

NOW = dt.datetime(2024, 1, 1, 12, 0, 0)


def column(spark, values, ddl, expression):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r[0] for r in rows.orderBy("i").select(expression()).collect()]


def reasons(spark, **changes):
    row = {"mmsi": 525000001, "latitude": 0.0, "longitude": 0.0, "speed": 1.0, "ts": NOW, **changes}
    df = spark.createDataFrame([tuple(row.values())], "mmsi long, latitude double, longitude double, speed double, ts timestamp")
    return validate.with_reject_reason(df, F.lit(NOW)).first().reject_reason


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({}, None),
        ({"mmsi": 0}, "INVALID_MMSI"),
        ({"mmsi": None}, "INVALID_MMSI"),
        ({"latitude": 90.0}, None),
        ({"latitude": -90.0001}, "INVALID_COORDINATES"),
        ({"longitude": 180.0001}, "INVALID_COORDINATES"),
        ({"longitude": None}, "INVALID_COORDINATES"),
        ({"speed": None}, "INVALID_SPEED"),
        ({"speed": -0.1}, "INVALID_SPEED"),
        ({"speed": 0.0}, None),
        ({"speed": 102.3}, None),
        ({"speed": 102.4}, "INVALID_SPEED"),
        ({"ts": None}, "MISSING_TIMESTAMP"),
        ({"ts": NOW + dt.timedelta(milliseconds=60_000)}, None),
        ({"ts": NOW + dt.timedelta(milliseconds=60_001)}, "FUTURE_TIMESTAMP"),
        ({"ts": NOW - dt.timedelta(milliseconds=3_600_000)}, None),
        ({"ts": NOW - dt.timedelta(milliseconds=3_600_001)}, "OLD_TIMESTAMP"),
        ({"mmsi": -1, "latitude": 99.0, "speed": None, "ts": None}, "INVALID_MMSI"),
    ],
)
def test_first_failing_rule(spark, changes, reason):
    assert reasons(spark, **changes) == reason


def test_names_and_codes(spark):
    names = ["MT X", "MT1", "PELNI TANKER", "", None, "ferry", "mv a", "Fishy", "CARGO MT Z"]
    assert column(spark, names, "n string", lambda: vessel.type_from_name(F.col("n"))) == [
        "TANKER", "OTHER", "PASSENGER", "OTHER", "UNKNOWN", "PASSENGER", "CARGO", "FISHING", "TANKER",
    ]
    assert column(spark, [5, 15, 9, None], "c int", lambda: vessel.navigation_status_text(F.col("c"))) == [
        "Moored", "Not defined", "Reserved", "Unknown",
    ]
    assert column(spark, [0, 10, None], "c int", lambda: weather.sea_state_text(F.col("c"))) == [
        "Calm (glassy) - 0m", "Invalid", "Unknown",
    ]


def test_grids_round_differently(spark):
    lat = [-0.05, 1.29, -6.1055, -0.15]
    both = lambda f: column(spark, [(x, x) for x in lat], "a double, b double", lambda: f(F.col("a"), F.col("b")))
    assert [x.split("_")[0] for x in both(geo.position_cell)] == ["0", "12", "-61", "-1"]
    assert [x.split("_")[0] for x in both(geo.weather_cell)] == ["0", "13", "-61", "-1"]
    assert column(spark, [(None, 1.0)], "a double, b double", lambda: geo.position_cell(F.col("a"), F.col("b"))) == ["UNKNOWN"]
    assert column(spark, [(1.2345, 103.8765)], "a double, b double", lambda: geo.weather_cell(F.col("a"), F.col("b"))) == ["12_1039"]


def test_octants(spark):
    assert column(spark, [0.0, 22.4, 22.5, 337.4, 337.5, 360.0, None], "c double", lambda: geo.compass_octant(F.col("c"))) == [
        "N", "N", "NE", "NW", "N", "N", None,
    ]


def test_port_and_weather_texts(spark):
    levels = [29, 30, 69, 70, 71, None]
    assert column(spark, levels, "l int", lambda: port.congestion_text(F.col("l"))) == [
        "Low", "Moderate", "Moderate", "High", "High", "Unknown",
    ]
    assert column(spark, levels, "l int", lambda: port.is_congested(F.col("l"))) == [False] * 4 + [True, False]
    cases = [(4.1, 1.0, 10.0, 10.0), (0.0, 1.0, 1.9, 10.0), (0.0, 5.1, 10.0, 81.0), (0.0, 1.0, 10.0, 61.0), (0.0, 1.0, 10.0, 60.0)]
    kinds = column(spark, cases, "w double, s double, v double, h double", lambda: weather.weather_condition(F.col("w"), F.col("s"), F.col("v"), F.col("h")))
    assert [k.type for k in kinds] == ["stormy", "foggy", "rainy", "cloudy", "clear"]
    assert kinds[4].intensity == 0.2
    safe = [(2000.0, 6, 19.9), (1000.0, 6, 1.0), (2000.0, 7, 1.0), (2000.0, 1, 25.0), (None, 1, 1.0)]
    assert column(spark, safe, "v double, s int, w double", lambda: weather.safe_for_navigation(F.col("v"), F.col("s"), F.col("w"))) == [
        True, False, False, False, False,
    ]


def test_completeness(spark):
    def score(name, speed, heading, dest, minutes):
        df = spark.createDataFrame(
            [(name, speed, speed, heading, heading, dest, NOW - dt.timedelta(minutes=minutes))],
            "n string, s double, c double, h int, ns int, d string, ts timestamp",
        )
        return df.select(
            vessel.completeness_score(*[F.col(c) for c in ("n", "s", "c", "h", "ns", "d", "ts")], F.lit(NOW))
        ).first()[0]

    assert score("A", 1.0, 1, "X", 0) == 100
    assert score(" ", 1.0, 1, None, 0) == 80
    assert [score("A", 1.0, 1, "X", m) for m in (10, 11, 30, 31)] == [100, 90, 90, 80]
    assert score(None, None, None, None, 31) == 30


@pytest.mark.parametrize(
    "spelling, millis",
    [
        ('"1709114415.123000000"', 1709114415123),
        ('"1709114415"', 1709114415000),
        ("1709114415123", 1709114415123),
        ('"2026-02-28T10:30:15Z"', 1772274615000),
        ('"abc"', None),
        (None, 1704110400000),
        ("null", 1704110400000),
    ],
)
def test_instants(spark, spelling, millis):
    assert column(spark, [(spelling,)], "t string", lambda: times.instant_millis(F.col("t"), F.lit(NOW))) == [millis]


def fixes(spark, rows):
    """(seconds, speed, name) rows of one vessel."""
    data = [
        (1, name, 0.0, 0.0, float(v), 0.0, 0, "x", NOW + dt.timedelta(seconds=s), i)
        for i, (s, v, name) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "mmsi long, vessel_name string, latitude double, longitude double, speed double, course double, heading int, "
        "status string, ts timestamp, seq long",
    )


def kinds(spark, rows):
    found = detect.speed_candidates(enrich.enriched(fixes(spark, rows)))
    return [(r.seq, r.alert_type) for r in found.orderBy("seq", "check_order").collect()]


@pytest.mark.parametrize("name, limit", [("MV A", 37.5), ("KM PELNI", 52.5), ("MT A", 30.0), ("FISH", 37.5)])
def test_excessive_speed_limits(spark, name, limit):
    rows = [(0, 99.0, name), (1000, limit, name), (2000, limit + 0.1, name)]
    assert [k for k in kinds(spark, rows) if k[1] == detect.EXCESSIVE] == [(2, detect.EXCESSIVE)]


def test_stop_and_acceleration_limits(spark):
    assert kinds(spark, [(0, 10.0, "A"), (1000, 0.5, "A")]) == []
    assert kinds(spark, [(0, 10.1, "A"), (1000, 0.9, "A")]) == [(1, detect.STOP)]
    assert kinds(spark, [(0, 10.1, "A"), (1000, 1.0, "A")]) == []
    assert kinds(spark, [(0, 5.0, "A"), (10, 15.0, "A")]) == []
    assert kinds(spark, [(0, 5.0, "A"), (9, 15.0, "A")]) == [(1, detect.ACCELERATION)]
    assert kinds(spark, [(0, 5.0, "A"), (0, 15.0, "A")]) == []


def test_throttle_priority_and_clock(spark):
    # Row 1 meets two checks; row 2 is too soon and must not restart the clock; row 3 is 300.001 s after row 1.
    rows = [(0, 1.0, "A"), (5, 60.0, "A"), (200, 60.0, "A"), (305, 60.0, "A"), (305.001, 60.0, "A")]
    passed = throttle.throttled(detect.first_check(enrich.enriched(fixes(spark, rows), 60)), seconds=60)
    alerts = detect.speed_alert_rows(passed).orderBy("seq").collect()
    assert [(a.seq, a.alert_type, a.severity) for a in alerts] == [(1, "EXCESSIVE_SPEED", "HIGH"), (4, "EXCESSIVE_SPEED", "HIGH")]
    assert alerts[0].description == "Vessel A traveling at 60.0 knots (max expected: 25.0 knots)"
    assert alerts[0].details["max_expected_speed"] == "25.0"


def test_track_gap(spark):
    rows = fixes(spark, [(0, 1.0, "A"), (900, 1.0, "A"), (1801, 1.0, "A")])
    starts = [r.row_number for r in tracks.with_track(rows, seconds=600).orderBy("seq").collect()]
    assert starts == [1, 2, 1]


def test_sliding_set(spark):
    minute = dt.timedelta(minutes=1)
    rows = spark.createDataFrame(
        [("p", f"a{i}", NOW + m * minute, i) for i, m in enumerate((-200, 0, 50, 105))], "port string, id string, ts timestamp, seq long"
    )

    def alive(at):
        return sorted(r.id for r in tables.live_members(rows, "port", "id", F.lit(NOW + at * minute), 3600, 600).collect())

    assert alive(160) == ["a1", "a2", "a3"]
    assert alive(165) == alive(166) == []
    assert alive(40) == ["a1"]


@pytest.mark.parametrize("bound", [100_000, 3])
def test_rules_are_a_table_of_any_size(spark, monkeypatch, bound):
    monkeypatch.setattr(rules.skew.fits_broadcast, "__defaults__", (bound,))
    many = [rules.Rule(i, f"r{i}", "SPEED", "speed", op, float(i % 40)) for i, op in enumerate(list(rules_ops) * 30)]
    many += [rules.Rule(900, "off", "SPEED", "speed", ">", 0.0, False), rules.Rule(901, "other", "SPEED", "unknown", ">", 0.0)]
    rows = spark.createDataFrame([(i, float(i)) for i in range(40)] + [(40, None)], "seq long, speed double")
    found = {(r.seq, r.rule_id) for r in rules.rule_hits(rows, rules.rule_table(spark, many), {"speed": F.col("speed")}).collect()}
    assert found == {(s, r.id) for s in range(40) for r in many[:-2] if rules_ops[r.op](float(s), r.threshold)}


rules_ops = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}


def test_search_reads(spark):
    vessels = spark.createDataFrame(
        [(1, "MV Sea 100%", "A", "ID", "i", "c", NOW, 1), (2, "MV Sea 100x", "A", "ID", "i", "c", NOW, 2)],
        "mmsi long, vessel_name string, vessel_type string, flag string, imo string, call_sign string, ts timestamp, seq long",
    )
    assert [r.mmsi for r in reads.search_vessels(vessels, "100%").collect()] == [1]
    assert reads.search_vessels(vessels, "s").count() == 0
    assert [r.mmsi for r in reads.name_match(vessels, "sea 100x").collect()] == [2, 1]


def one_pass(x, y, tolerance):
    """Douglas-Peucker over a whole track, plainly recursive."""

    def go(a, b):
        far, at = 0.0, None
        dx, dy = x[b] - x[a], y[b] - y[a]
        square = dx * dx + dy * dy
        for i in range(a + 1, b):
            t = min(1.0, max(0.0, ((x[i] - x[a]) * dx + (y[i] - y[a]) * dy) / square)) if square > 0 else 0.0
            off = math.hypot(x[i] - x[a] - t * dx, y[i] - y[a] - t * dy)
            if off > far:
                far, at = off, i
        return go(a, at) | go(at, b) if far > tolerance else {a, b}

    return sorted(go(0, len(x) - 1))


@pytest.mark.parametrize("block", [16, 50, 10_000])
def test_simplification_does_not_depend_on_the_block(spark, block):
    import numpy as np

    rng = np.random.default_rng(2)
    n = 300
    walk = np.cumsum(rng.normal(0, 0.002, (n, 2)), axis=0) + [0.0, 179.99]  # wanders over the date line
    line = np.stack([np.zeros(n), np.arange(n) * 0.001], axis=1)
    rows, expected = [], {}
    for mmsi, track in ((1, walk), (2, line)):
        lat, lon = track[:, 0], (track[:, 1] + 180) % 360 - 180
        rows += [(mmsi, float(a), float(o), 1.0, 0.0, NOW + dt.timedelta(seconds=i), i) for i, (a, o) in enumerate(zip(lat, lon))]
        expected[mmsi] = one_pass(track[:, 1] * 60 * np.cos(np.radians(lat.mean())), lat * 60, 0.1)
    df = spark.createDataFrame(rows, "mmsi long, latitude double, longitude double, speed double, course double, ts timestamp, seq long")
    tracked = tracks.with_track(df, seconds=60)
    found = tracks.simplified(tracked, 0.1, block).collect()
    for mmsi, points in expected.items():
        assert sorted(r.seq for r in found if r.mmsi == mmsi) == points
    assert expected[2] == [0, n - 1] and 2 < len(expected[1]) < n
    lines = {r.mmsi: r.points for r in tracks.track_lines(tracked).collect()}
    assert lines == {1: n, 2: n}


def test_the_date_line_is_not_averaged_away(spark):
    rows = [(1, 0.0, lon, 1.0, 0.0, NOW + dt.timedelta(seconds=120 * i), i) for i, lon in enumerate((179.7, 179.9, -179.9, -179.7))]
    df = spark.createDataFrame(rows, "mmsi long, latitude double, longitude double, speed double, course double, ts timestamp, seq long")
    smooth = {r.seq: r.smooth_longitude for r in tracks.smoothed(tracks.with_track(df, seconds=60), 1).collect()}
    assert smooth[1] == pytest.approx((179.7 + 179.9 + 180.1) / 3) and smooth[2] == pytest.approx(-(179.7 + 179.9 + 180.1) / 3)
    filled = [r.longitude for r in tracks.gap_filled(df, seconds=60).where("seq = 1 AND interpolated").collect()]
    assert filled == pytest.approx([-180.0])
