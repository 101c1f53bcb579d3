"""Sliced sequence operators against plain windows over whole keys."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fairlead.operators import sequence

def in_order():
    return Window.partitionBy("mmsi").orderBy("ts", "seq")


@pytest.fixture(scope="module")
def fixes(spark):
    rng = np.random.default_rng(5)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        # One vessel holds a third of the rows; equal times occur.
        key = 1 if i % 3 == 0 else int(rng.integers(2, 40))
        rows.append((key, base + dt.timedelta(seconds=int(rng.integers(0, 20_000))), i, float(rng.uniform(0, 50))))
    return spark.createDataFrame(rows, "mmsi long, ts timestamp, seq long, speed double").cache()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("seconds", [60, 700, 10**6])
def test_context(fixes, seconds):
    got = sequence.with_context(
        fixes, previous={"prev": ["speed"]}, following={"next": ["ts", "speed"]}, number="n", seconds=seconds
    ).select("seq", "prev.speed", "next", "n")
    want = fixes.select(
        "seq", F.lag("speed").over(in_order()), F.lead(F.struct("ts", "speed")).over(in_order()), F.row_number().over(in_order()).cast("bigint")
    )
    assert same(got, want)


@pytest.mark.parametrize("seconds", [60, 700, 10**6])
@pytest.mark.parametrize("gap_ms", [5_000, 120_000, 10**9])
def test_runs(fixes, seconds, gap_ms):
    got = sequence.with_runs(fixes, ["speed"], gap_ms, seconds=seconds).select(
        "seq", "prev.speed", "run_start", "row_number", "run_ends"
    )
    starts = F.lag("ts").over(in_order()).isNull() | (F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(in_order())) > gap_ms)
    flagged = fixes.withColumn("p", F.lag("speed").over(in_order())).withColumn("s", starts.cast("int"))
    numbered = flagged.withColumn("run", F.sum("s").over(in_order()))
    R = Window.partitionBy("mmsi", "run").orderBy("ts", "seq")
    want = numbered.select(
        "seq", "p", F.min("ts").over(Window.partitionBy("mmsi", "run")), F.row_number().over(R).cast("bigint"),
        F.lead("ts").over(R).isNull(),
    )
    assert same(got, want)


def test_trailing(fixes):
    got = sequence.with_trailing(fixes, {"low": ("min", "speed"), "n": ("count", "speed")}, 300, seconds=400).select(
        "seq", "low", "n"
    )
    frame = Window.partitionBy("mmsi").orderBy(F.unix_seconds("ts")).rangeBetween(-300, 0)
    assert same(got, fixes.select("seq", F.min("speed").over(frame), F.count("speed").over(frame)))
    with pytest.raises(ValueError):
        sequence.with_trailing(fixes, {"low": ("min", "speed")}, 300, seconds=200)


def test_surrounding(fixes):
    numbered = sequence.with_row_number(fixes)
    got = sequence.with_surrounding(numbered, {"n": F.sum("seq")}, 3, keys=["mmsi"], block=7).select("seq", "n")
    assert same(got, fixes.select("seq", F.sum("seq").over(in_order().rowsBetween(-3, 3))))


def test_latest_and_newest(fixes):
    latest = sequence.latest_per_key(fixes, ["mmsi"])
    back = Window.partitionBy("mmsi").orderBy(F.desc("ts"), F.desc("seq"))
    ranked = fixes.withColumn("rank", F.row_number().over(back))
    assert same(latest, ranked.where("rank = 1").drop("rank"))
    assert same(sequence.newest_n_per_key(fixes, 5, ["mmsi"]), ranked.where("rank <= 5"))


def test_slices_follow_the_busiest_key(fixes):
    assert sequence.slice_seconds(fixes, rows=10**9) == sequence.SLICE_SECONDS
    short = sequence.slice_seconds(fixes, rows=2)
    assert 0.001 <= short < 60
    most = fixes.groupBy("mmsi", F.date_trunc("minute", "ts")).count().agg(F.max("count")).first()[0]
    assert short == pytest.approx(120 / most)
    got = sequence.with_previous(fixes, ["speed"], seconds=short).select("seq", "prev.speed")
    assert same(got, fixes.select("seq", F.lag("speed").over(in_order())))
