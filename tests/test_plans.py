"""Shapes of physical plans."""

import pytest

from fairlead.operators import detect, enrich, proximity, reads, tables
from fairlead.plans import common, lenses
from fairlead.plans.registry import load
from fairlead.session import scratch_path
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    """Plans as they are when nothing is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_movement_moves_wide_rows_once(spark, no_broadcast):
    rows = detect.speed_candidates(enrich.enriched(common.valid(spark, SF_DIR)))
    text = plan(rows)
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning(mmsi" in line and "_slice" in line]
    # The rows themselves, the slice summaries, and the carried values on their way back.
    assert len(wide) == 3
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_pairs_are_an_equi_join(spark, no_broadcast):
    text = plan(proximity.close_pairs(proximity.window_fixes(common.valid(spark, SF_DIR))))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "ATAN2" in text.upper().split("INNER")[1]


@pytest.mark.parametrize("name", ["geofence_events", "rule_alerts", "enrich_with_master", "box_subscription", "track_simplified"])
def test_no_cross_join(spark, name):
    text = plan(load()[name].build(spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_history_read_is_pruned(spark):
    path = scratch_path(spark, "history")
    tables.append_history(common.valid_long(spark, SF_DIR), path, 0)
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-25"))
    stored = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    text = plan(reads.vessel_history(stored, 525_000_005, start, end))
    assert "PartitionFilters: [isnotnull(ym" in text
    assert "PushedFilters: [IsNotNull(mmsi), IsNotNull(ts), EqualTo(mmsi,525000005)" in text


def test_scans_read_only_needed_columns(spark):
    text = plan(load()["port_list"].build(spark, SF_DIR))
    assert "o_totalprice" not in text
    text = plan(load()["density_grid"].build(spark, SF_DIR))
    assert "props" not in text


def test_newest_rows_are_cut_before_the_shuffle(spark):
    assert plan(load()["last_n_positions"].build(spark, SF_DIR)).count("WindowGroupLimit") == 2


def test_flagship_has_no_full_sort_to_one_task(spark):
    assert "SinglePartition" not in plan(lenses.positions(spark, SF_DIR).transform(enrich.with_movement))


def test_rejects_are_parsed_once(spark):
    from fairlead.operators import validate
    from fairlead.plans import ingest
    from fairlead.sources import wire

    rows = wire.positions_from_envelopes(ingest.envelope_texts(spark, "/root/testdata/sf0.001"))
    failed = validate.position_reject_reason(F.lit(None).cast("timestamp"), check_age=False)
    _, rejects = validate.split_rejects(rows.withColumn("reject_reason", F.coalesce("reject_reason", failed)))
    assert rejects._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
