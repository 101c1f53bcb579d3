"""Merges, history, retention, skew joins and wire forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fairlead.functions import times
from fairlead.operators import rollups, skew, tables
from fairlead.session import children, scratch_path
from fairlead.sources import files, wire

T0 = dt.datetime(2024, 1, 1)
RULE = tables.MergeRule(keys=("k",), mutable=("v", "ts"), fixed=("first",))
ROWS = "k long, v long, first string, ts timestamp, seq long"


def batch(spark, *rows):
    return spark.createDataFrame([(k, v, f, T0 + dt.timedelta(seconds=s), i) for i, (k, v, f, s) in enumerate(rows)], ROWS)


def state(table):
    return sorted((r.k, r.v, r["first"]) for r in table.read().collect())


def test_merge_keeps_first_and_last(spark):
    table = tables.CurrentTable(spark, scratch_path(spark, "t"), RULE, batch(spark, (0, 0, "", 0)).schema)
    assert state(table) == []
    table.upsert(batch(spark, (1, 10, "a", 10), (1, 11, "b", 11), (2, 20, "c", 5)), 0)
    assert state(table) == [(1, 11, "a"), (2, 20, "c")]
    second = batch(spark, (1, 12, "z", 12), (2, 21, "z", 1), (3, None, None, 1))
    table.upsert(second, 1)
    table.upsert(second, 1)
    # The late row of key 2 does not roll it back, and first-written values stay even against an older row.
    want = [(1, 12, "a"), (2, 20, "c"), (3, None, None)]
    assert sorted(state(table), key=str) == sorted(want, key=str)
    table.compact(0)
    assert sorted(state(table), key=str) == sorted(want, key=str)
    table.compact(1)
    table.compact(1)
    again = tables.CurrentTable(spark, table.path, RULE, batch(spark, (0, 0, "", 0)).schema)
    assert sorted(state(again), key=str) == sorted(want, key=str)
    again.upsert(batch(spark, (3, 33, "late", 9)), 2)
    assert (3, 33, None) in state(again)


def test_folders_of_a_current_table_stay_few(spark, monkeypatch):
    monkeypatch.setattr(tables, "COMPACT_EVERY", 3)
    table = tables.CurrentTable(spark, scratch_path(spark, "few"), RULE, batch(spark, (0, 0, "", 0)).schema)
    for i in range(12):
        table.upsert(batch(spark, (i % 2, i, f"f{i}", i)), i)
        assert len(children(spark, f"{table.path}/batches")) <= 12 and len(children(spark, f"{table.path}/bases")) <= 6
    assert state(table) == [(0, 10, "f0"), (1, 11, "f1")]


def test_closed_months_are_compacted_and_dropped(spark):
    path = scratch_path(spark, "months")
    for number, day in enumerate((0, 1, 2, 40)):
        tables.append_history(batch(spark, (number, number, "a", day * 86400)).withColumn("mmsi", F.col("k")), path, number)
    tables.compact_month(spark, path, 202401)
    assert [n for n in children(spark, f"{path}/ym=202401") if n.startswith("batch_id")] == ["batch_id=2"]
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]
    assert tables.drop_expired_months(spark, path, dt.date(2026, 2, 3), 2) == ["ym=202401"]
    assert [r.k for r in spark.read.parquet(path).collect()] == [3]


@pytest.mark.parametrize("fails", range(5))
def test_compaction_goes_on_after_a_failure(spark, monkeypatch, fails):
    path, calls = scratch_path(spark, "broken"), []
    for number in range(3):
        tables.append_history(batch(spark, (number, number, "a", number * 86400)).withColumn("mmsi", F.col("k")), path, number)

    def failing(own):
        def call(*args):
            calls.append(args)
            if len(calls) == fails + 1:
                raise OSError("the driver is gone")
            return own(*args)

        return call

    with monkeypatch.context() as patch:
        patch.setattr(tables, "remove", failing(tables.remove))
        patch.setattr(tables, "rename", failing(tables.rename))
        with pytest.raises(OSError, match="the driver is gone"):
            tables.compact_month(spark, path, 202401)
    late = batch(spark, (7, 7, "a", 5 * 86400)).withColumn("mmsi", F.col("k"))
    if fails < 4:  # otherwise the month is already whole
        tables.append_history(late, path, 7)
    tables.compact_month(spark, path, 202401)
    left = [n for n in children(spark, f"{path}/ym=202401") if n.startswith("batch_id")]
    assert left == (["batch_id=2", "batch_id=7"] if fails < 4 else ["batch_id=2"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ([0, 1, 2, 7] if fails < 4 else [0, 1, 2])


def test_history_replay_replaces_itself(spark):
    path = scratch_path(spark, "h")
    for number, rows in ((0, batch(spark, (1, 1, "a", 0))), (1, batch(spark, (2, 2, "b", 40 * 86400)))):
        for _ in range(2):
            tables.append_history(rows.withColumn("mmsi", F.col("k")), path, number)
    stored = spark.read.parquet(path)
    assert sorted((r.k, str(r.ym)) for r in stored.collect()) == [(1, "202401"), (2, "202402")]
    pruned = stored.where(F.col("ym") == 202402)
    assert "PartitionFilters: [isnotnull(ym" in pruned._jdf.queryExecution().executedPlan().toString()


def test_retention_edge(spark):
    rows = spark.createDataFrame([(dt.datetime(2022, 3, 1),), (dt.datetime(2022, 2, 28, 23, 59),)], "ts timestamp")
    kept = tables.retained(tables.with_history_columns(rows), F.lit(dt.datetime(2024, 3, 1, 5)), 2)
    assert [r.ts for r in kept.collect()] == [dt.datetime(2022, 3, 1)]


def test_rollup_of_parts_is_rollup_of_whole(spark):
    rows = spark.range(500).select(
        (F.col("id") % 7).alias("mmsi"),
        F.timestamp_seconds(F.col("id") * 13).alias("ts"),
        (F.col("id") % 5).cast("double").alias("speed"),
        F.lit(1.0).alias("latitude"),
        F.lit(2.0).alias("longitude"),
    )
    r = rollups.POSITIONS_PER_MINUTE
    whole = r.finished(r.state(rows))
    parts = r.finished(r.merged([r.state(rows.where("speed < 2")), r.state(rows.where("speed >= 2"))]))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_sketch_is_close(spark):
    rows = spark.range(20_000).select(
        F.lit("A").alias("alert_type"), F.lit("LOW").alias("severity"), F.lit(T0).alias("ts"), (F.col("id") % 5000).alias("mmsi")
    )
    halves = [rollups.alerts_daily_sketch(rows.where(f"mmsi % 2 = {i}")) for i in (0, 1)]
    merged = rollups.merge_alert_sketches(halves).select(F.hll_sketch_estimate("vessel_sketch").alias("n")).first().n
    assert abs(merged - 5000) < 250


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    fact = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x")
    )
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    plain = fact.join(dim, "k", how)
    for options in ({"salts": 8, "top": 2}, {"salts": 3, "top": 1000}):
        salted = skew.salted_join(fact, dim, ["k"], [F.col("x")], how, **options).select(plain.columns)
        assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0
    for bound in (5, 1000):
        joined = skew.join_dimension(fact, dim, ["k"], [F.col("x")], how, max_rows=bound).select(plain.columns)
        assert plain.exceptAll(joined).count() == 0 and joined.exceptAll(plain).count() == 0


def test_hot_key_is_spread(spark):
    fact = spark.range(9000).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    dim = spark.range(9000).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.salted_join(fact, dim, ["k"], [F.col("x")], "inner", salts=64)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 9000 and max(sizes) < 9000 * 0.45


def test_vessel_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text(
        "MMSI|Ship Name|IMO|Call Sign|Type Code|Latitude|Longitude|Area\n# note\n\n"
        "525000001| A |9000001|YB1|70|-6.1|106.8|Java\n525000002|B|9|YB|70|-6.1|106.8\nx|C|9|YB|70|-6.1|106.8|Java\n"
    )
    rows = files.vessel_file(spark, str(tmp_path)).collect()
    assert [(r.mmsi, r.vessel_name, r.type_code) for r in rows] == [(525000001, "A", 70)]


def test_double_encoding_and_spelling(spark):
    inner = '{"mmsi": "7", "timestamp": "1709114415.5"}'
    quoted = '"' + inner.replace('"', '\\"') + '"'
    rows = wire.unquoted(spark.createDataFrame([(inner,), (quoted,)], "value string"))
    got = rows.select(F.get_json_object("value", "$.mmsi").alias("m"), times.instant_millis(wire.spelled(F.col("value"), "timestamp"), F.lit(T0)).alias("t"))
    assert {tuple(r) for r in got.collect()} == {("7", 1709114415500)}


def test_envelope_rejects(spark):
    good = '{"id":"a","collectorId":"c","parsedData":{"mmsi":1,"latitude":1.5,"navigationStatusDescription":"Moored","timestamp":"2024-01-01T12:00:00Z"}}'
    rows = spark.createDataFrame([(good,), ("not a json",), ('{"id":"b"}',)], "value string")
    got = wire.positions_from_envelopes(rows).collect()
    assert [r.reject_reason for r in got] == [None, "PARSE_ERROR", "NO_PAYLOAD"]
    assert (got[0].mmsi, got[0].status, got[0].source) == (1, "Moored", "c") and got[1].rejected_value == "not a json"


def test_routing_fixtures(spark):
    texts = ['{"temperature":25.5,"humidity":80}', '{"mmsi":1}', '{"port_code":"X"}', "mmsi", '["mmsi"]', '{"a":1}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = [r.payload_type for r in wire.with_payload_type(rows).orderBy("i").collect()]
    assert got == ["WEATHER", "AIS", "PORT", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_raw_feed_defaults(spark):
    text = '{"MessageType":"P","MetaData":{"MMSI":1},"Message":{"PositionReport":{"Latitude":1,"Longitude":2,"Timestamp":"1704110400000"},"StaticDataReport":{"Dimension":{"A":3,"C":2,"D":1}}}}'
    r = wire.positions_from_feed(spark.createDataFrame([(text,)], "value string"), F.lit(T0)).first()
    assert (r.vessel_name, r.speed, r.course, r.length, r.width) == ("Unknown", 0.0, 0.0, 3.0, 3.0)
    assert r.ts == dt.datetime(2024, 1, 1, 12)
