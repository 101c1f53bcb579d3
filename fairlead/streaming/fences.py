"""Fence events of a position stream whose fences change while it runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators import sequence, spatial, tables
from fairlead.session import exists

#: The newest fix of a vessel and the fences around it.
CARRIED = "mmsi bigint, inside array<int>, ts timestamp, seq bigint"
INSIDE_RULE = tables.MergeRule(keys=("mmsi",), mutable=("inside", "ts", "seq"), fixed=())


@dataclass
class FenceWatch:
    """ENTRY and EXIT per (vessel, fence), batch by batch, in DataFrame operations only.

    ``fences`` is called for every batch and returns the fence log as it is then (see ``spatial.fence_versions``): a fence
    that is added, moved or switched off counts from its own time on, so the events do not depend on how the stream is
    cut. Positions meet fences by the same checked joins as at rest. What a batch hands to the next, the fences around
    each vessel at its newest fix, is a current-state table; a replay of a batch reads the state before it. Fixes behind
    the newest one of an earlier batch are no longer in order; they go to the late rows.
    """

    folder: str
    fences: Callable[[SparkSession], DataFrame]
    carried: tables.CurrentTable
    seconds: float = sequence.SLICE_SECONDS

    @classmethod
    def at(cls, spark: SparkSession, folder: str, fences: Callable[[SparkSession], DataFrame], seconds: float = sequence.SLICE_SECONDS) -> FenceWatch:
        shape = spark.createDataFrame([], CARRIED).schema
        return cls(folder, fences, tables.CurrentTable(spark, f"{folder}/inside", INSIDE_RULE, shape), seconds)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        done = f"{self.folder}/inside/batches/id={int(batch_id)}/_SUCCESS"
        if not exists(spark, done):
            self._write(spark, rows.select("mmsi", "latitude", "longitude", "ts", "seq"), batch_id)
        self.carried.compact_if_due(batch_id)

    def _write(self, spark: SparkSession, rows: DataFrame, batch_id: int) -> None:
        # A micro-batch may come as one file, so one task: its fixes are dealt out before they meet the fences.
        dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mmsi", "ts", "seq")
        inside = spatial.with_fences_inside(dealt, spatial.fence_versions(self.fences(spark))).select("mmsi", "inside", "ts", "seq")
        # Read by the late rows and, twice, by the events: folded once.
        self.carried.read(upto=batch_id - 1).select("mmsi", "inside", "ts", "seq").write.mode("overwrite").parquet(f"{self.folder}/before")
        before = spark.read.schema(CARRIED).parquet(f"{self.folder}/before")
        newest = before.select(F.col("mmsi").alias("_of"), F.struct("ts", "seq").alias("_newest"))
        placed = inside.join(newest, F.col("mmsi") == F.col("_of"), "left").withColumn("late", F.coalesce(F.struct("ts", "seq") <= F.col("_newest"), F.lit(False)))
        # Read by the events, the late rows and the state: worked out once.
        placed.select("mmsi", "inside", "ts", "seq", "late").write.mode("overwrite").parquet(f"{self.folder}/placed")
        placed = spark.read.schema(f"{CARRIED}, late boolean").parquet(f"{self.folder}/placed")
        fresh = placed.where("NOT late").drop("late")
        both = fresh.withColumn("_old", F.lit(False)).unionByName(before.withColumn("_old", F.lit(True)))
        linked = sequence.with_previous(both, ["inside"], seconds=self.seconds).where("NOT _old")
        before_ = F.coalesce("prev.inside", F.array().cast("array<int>"))

        def events(ids: Column, kind: str) -> Column:
            return F.transform(ids, lambda i: F.struct(i.alias("fence_id"), F.lit(kind).alias("event")))

        changes = F.concat(events(F.array_except("inside", before_), "ENTRY"), events(F.array_except(before_, F.col("inside")), "EXIT"))
        found = linked.select("mmsi", "ts", "seq", F.explode(changes).alias("_e")).select("mmsi", "ts", "seq", "_e.*")
        found.write.mode("overwrite").parquet(f"{self.folder}/events/batch_id={int(batch_id)}")
        placed.where("late").drop("late").write.mode("overwrite").parquet(f"{self.folder}/late/batch_id={int(batch_id)}")
        # Last of all: its folder tells that the batch is complete.
        self.carried.upsert(fresh, batch_id, compact=False)

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("mmsi bigint, ts timestamp, seq bigint, fence_id int, event string, batch_id bigint").parquet(f"{self.folder}/events").drop("batch_id")

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{CARRIED}, batch_id bigint").parquet(f"{self.folder}/late").drop("batch_id")
