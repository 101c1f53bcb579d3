"""The sliced throttle against the plain greedy rule."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairlead.operators import throttle

INTERVAL = 300_000


def greedy(ms, interval=INTERVAL):
    passed, last = [], None
    for m in ms:
        if last is None or m - last > interval:
            passed.append(m)
            last = m
    return passed


times = st.lists(st.integers(0, 5_000_000), min_size=1, max_size=80, unique=True).map(sorted)


@given(times, st.sampled_from([50_000, 300_000, 900_000]))
@settings(max_examples=300, deadline=None)
def test_composed_slices_give_the_greedy_result(ms, width):
    slices = {}
    for m in ms:
        slices.setdefault(m // width, []).append(m)
    parts = [np.array(v) for _, v in sorted(slices.items())]
    release, passed = throttle.NEVER, []
    for part in parts:
        bounds, exits = throttle.slice_steps(part, part[0] + INTERVAL, INTERVAL)
        passed += [int(part[i]) for i in throttle.survivors(part, release, INTERVAL)]
        release = int(throttle.apply_steps(np.array([release]), bounds, exits)[0])
    assert passed == greedy(ms)
    assert release == passed[-1] + INTERVAL


@given(times, st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_composition_is_application_in_turn(ms, pieces):
    parts = [p for p in np.array_split(np.array(ms), pieces) if len(p)]
    steps = [throttle.slice_steps(p, p[0] + INTERVAL, INTERVAL) for p in parts]
    both = throttle.compose(steps)
    for entry in [throttle.NEVER, *(p[0] - 1 for p in parts[:1]), parts[0][0] + INTERVAL - 1]:
        one_by_one = np.array([entry])
        for bounds, exits in steps:
            one_by_one = throttle.apply_steps(one_by_one, bounds, exits)
        assert throttle.apply_steps(np.array([entry]), *both)[0] == one_by_one[0]


def rows_of(spark, data):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(milliseconds=ms), i) for i, (k, ms) in enumerate(data)]
    return spark.createDataFrame(rows, "mmsi long, ts timestamp, seq long")


def passed_ms(df):
    base = F.unix_millis(F.lit(dt.datetime(2024, 1, 1)))
    return sorted((r[0], r[1]) for r in df.select("mmsi", F.unix_millis("ts") - base).collect())


def test_boundary_of_the_interval(spark):
    data = [(1, m) for m in (0, 200_000, 300_000, 300_001, 500_000, 600_002)]
    assert passed_ms(throttle.throttled(rows_of(spark, data), seconds=60)) == [(1, 0), (1, 300_001), (1, 600_002)]


def test_one_busy_vessel_and_many_quiet_ones(spark):
    """A third of all rows on one key, without any gap, over many slices and all levels of the tree."""
    rng = np.random.default_rng(3)
    busy = [(1, int(m)) for m in rng.integers(0, 40_000_000, 6000)]
    quiet = [(int(k), int(m)) for k, m in zip(rng.integers(2, 60, 12000), rng.integers(0, 40_000_000, 12000))]
    data = busy + quiet
    for options in ({"seconds": 600, "fan_out": 3, "levels": 2}, {"seconds": 120, "fan_out": 8}):
        got = passed_ms(throttle.throttled(rows_of(spark, data), **options))
        want = sorted(
            (k, m) for k in {k for k, _ in data} for m in greedy(sorted({m for kk, m in data if kk == k}))
        )
        assert got == want


def test_ties_inside_a_millisecond_go_to_the_first(spark):
    df = rows_of(spark, [(1, 5), (1, 5), (1, 5)])
    assert [r.seq for r in throttle.throttled(df).collect()] == [0]


def test_tree_grows_with_the_slices():
    assert [throttle.tree_levels(n, 64) for n in (1, 64, 65, 4096, 4097)] == [0, 0, 1, 1, 2]


def test_few_candidates_of_a_key_are_walked_without_python(spark):
    """The walk and the tree give the same rows, also for rows without a key or a time, and repeated ones."""
    rng = np.random.default_rng(5)
    data = [(int(k), int(m)) for k, m in zip(rng.integers(1, 9, 300), rng.integers(0, 3_000_000, 300))]
    rows = rows_of(spark, data + data[:20] + [(None, 5), (None, 6)])
    rows = rows.unionByName(rows.limit(3).withColumn("ts", F.lit(None).cast("timestamp")))
    walked, climbed = throttle.throttled(rows, seconds=600), throttle.throttled(rows, seconds=600, few=0, fan_out=3)
    want = sorted((k, m) for k in {k for k, _ in data} for m in greedy(sorted({m for kk, m in data if kk == k})))
    assert passed_ms(walked) == passed_ms(climbed) == want
    text = throttle.throttled(rows, seconds=600)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in text
    assert "ArrowEvalPython" in climbed._jdf.queryExecution().optimizedPlan().toString()
