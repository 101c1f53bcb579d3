"""Pairs of vessels that come together: found once per block of windows, throttled without being exchanged or written."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairlead.operators import proximity, throttle

T0 = dt.datetime(1969, 12, 31, 23, 50)  # windows below and above zero
SHAPE = "mmsi long, latitude double, longitude double, speed double, course double, ts timestamp, seq long"


def crowd(spark, seed=3, n=600, vessels=25):
    """Vessels that move about over the date line and near a pole; some without a place or a number."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lat, lon = rng.choice([(0.0, 179.997), (0.0, -179.999), (0.03, 0.0), (89.995, 50.0), (None, 0.0)])
        lat = None if lat is None else lat + 0.004 * rng.randrange(4)
        rows.append((rng.choice([None, *range(vessels)]), lat, lon + 0.001 * rng.randrange(3), float(rng.randrange(30)), float(rng.randrange(360)),
                     T0 + dt.timedelta(microseconds=rng.randrange(1200 * 10**6)), i))
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def fixes(spark):
    held = proximity.window_fixes(crowd(spark)).cache()
    held.count()
    return held


@pytest.mark.parametrize("together", [False, True])
def test_blocks_of_windows_give_the_pairs_of_windows(spark, fixes, monkeypatch, together):
    want = proximity.close_pairs(fixes)
    for meetings in (16_000_000, 40):
        monkeypatch.setattr(proximity, "PART_MEETINGS", meetings)
        got = proximity.close_pairs(fixes, slide=proximity.SLIDE, together=together)
        assert [c for c in got.columns if c not in throttle.TOGETHER] == want.columns
        got = got.select(want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 100


def test_pairs_of_two_vessels_are_in_one_task_in_time_order(spark, fixes, monkeypatch):
    monkeypatch.setattr(proximity, "PART_MEETINGS", 40)  # the vessels of a place are dealt out
    got = proximity.close_pairs(fixes, slide=proximity.SLIDE, together=True)
    rows = got.select("mmsi_a", "mmsi_b", *throttle.TOGETHER, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), "window_start").collect()
    rows.sort(key=lambda r: r.at)
    tasks, ends = {}, {}
    for r in rows:
        assert tasks.setdefault((r.mmsi_a, r.mmsi_b), (r.task, r._part)) == (r.task, r._part)
        key = (r.task, r._part)
        assert ends.get(key, (r._block,))[0] <= r._block
        ends[key] = (r._block,)
    assert len({r._part for r in rows}) > 3


def greedy(rows, interval):
    passed, release = [], {}
    for key, ms, rank in sorted(rows, key=lambda r: (r[1], r[2])):
        if ms > release.get(key, throttle.NEVER):
            passed.append((key, ms, rank))
            release[key] = ms + interval
    return sorted(passed)


@pytest.mark.parametrize("least, interval", [(1, 250), (40, 250), (40, 30), (10**6, 250)])
def test_candidates_that_come_together_are_throttled_as_they_come(least, interval):
    rng = random.Random(least)
    columns = {c: [] for c in ("a", "b", "_ms", "rank", *throttle.TOGETHER)}
    for part in range(6):
        for block in range(12):
            if rng.random() < 0.2:
                continue
            for _ in range(rng.choice([0, 1, 8, 70])):
                # Ids beyond the range of two in one number; every part has its own first id.
                row = (10**17 * (part - 3) + rng.randrange(4), 10**18 + rng.randrange(5), block * 100 + rng.randrange(100), rng.random(), part * 7919 % 6, block)
                for c, v in zip(columns, row, strict=True):
                    columns[c].append(v)
    table = pa.table(columns)
    clock, found, seen = throttle.PairClock(2, interval), [], 0
    for rows in throttle.whole_blocks(iter(table.to_batches(max_chunksize=29)), least):
        column = lambda c: rows.column(c).to_numpy()  # noqa: B023, E731
        at = clock.passed([column("a"), column("b")], column("_ms"), [column("rank")], *[column(c) for c in throttle.TOGETHER])
        seen += rows.num_rows
        found += [((r["a"], r["b"]), r["_ms"], r["rank"]) for r in rows.take(pa.array(at)).to_pylist()]
    given = [((r["a"], r["b"]), r["_ms"], r["rank"]) for r in table.to_pylist()]
    assert seen == len(given) and sorted(found) == greedy(given, interval)
    assert len(clock.keys) <= 20  # pairs of the last part only


def test_candidates_out_of_order_are_refused():
    clock, one = throttle.PairClock(1, 100), np.array([1])
    clock.passed([one], np.array([500]), [], one, np.array([5]))
    with pytest.raises(ValueError, match="order of their blocks"):
        clock.passed([one], np.array([400]), [], one, np.array([4]))


def test_collision_alerts_write_no_pairs(spark, fixes, monkeypatch):
    risks = proximity.collision_risk(proximity.close_pairs(fixes), within_seconds=proximity.COLLISION_SECONDS)
    want = throttle.throttled(risks, ["mmsi_a", "mmsi_b"], ts="window_start", order=["tcpa_seconds"])
    want = want.select("mmsi_a", "mmsi_b", "window_start", "tcpa_seconds").collect()
    written = []
    monkeypatch.setattr(throttle, "stored_table", lambda df, name: written.append(name))
    pairs = proximity.close_pairs(fixes, slide=proximity.SLIDE, together=True)
    risks = proximity.collision_risk(pairs, within_seconds=proximity.COLLISION_SECONDS)
    passed = throttle.throttled(risks, ["mmsi_a", "mmsi_b"], ts="window_start", order=["tcpa_seconds"])
    assert passed.columns == [c for c in risks.columns if c not in throttle.TOGETHER] and not written
    got = passed.select("mmsi_a", "mmsi_b", "window_start", "tcpa_seconds").collect()
    assert sorted(got) == sorted(want) and len(got) > 20
    # Nothing is exchanged once there are pairs, which the two arrays of a place become.
    plan = proximity.collision_alerts(passed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.rindex("Generate inline")]
