"""Current-state tables, append-only history, retention and expiring views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from fairlead.functions import times
from fairlead.operators import sequence, skew
from fairlead.session import children, exists, remove, rename

# Batches that readers fold before a new base is written.
COMPACT_EVERY = 20


@dataclass(frozen=True)
class MergeRule:
    """How rows of one key become one row: ``mutable`` columns from the newest, ``fixed`` from the first written."""

    keys: tuple[str, ...]
    mutable: tuple[str, ...]
    fixed: tuple[str, ...]
    ts: str = "ts"
    seq: str = "seq"

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.keys, *self.mutable, *self.fixed, "_first", "_last")

    def reduced(self, rows: DataFrame, generation: int = 0) -> DataFrame:
        """One row per key of a batch, with the places of its first and last write."""
        place = F.struct(F.lit(generation).cast("bigint").alias("generation"), F.unix_micros(self.ts).alias("us"),
                         F.col(self.seq).alias("seq"))
        return self._fold(rows.withColumns({"_first": place, "_last": place}))

    def merged(self, states: Sequence[DataFrame]) -> DataFrame:
        return self._fold(reduce(DataFrame.unionByName, [s.select(*self.columns) for s in states]))

    def _fold(self, rows: DataFrame) -> DataFrame:
        # Event order decides what is newest, so a late batch cannot roll a vessel back; the first write is the
        # lowest generation, whatever its event time.
        event_order = F.struct("_last.us", "_last.seq")
        aggregates = [
            F.max_by(F.struct(*self.mutable, "_last"), event_order).alias("_m"),
            F.min_by(F.struct(*self.fixed, "_first"), F.col("_first")).alias("_f"),
        ]
        return rows.groupBy(*self.keys).agg(*aggregates).select(*self.keys, "_m.*", "_f.*").select(*self.columns)

    def plain(self, state: DataFrame) -> DataFrame:
        return state.drop("_first", "_last")


POSITION_RULE = MergeRule(
    keys=("mmsi",),
    mutable=("vessel_name", "latitude", "longitude", "speed", "course", "heading", "status", "ts", "destination",
             "eta", "draught"),
    fixed=("vessel_type", "flag", "call_sign", "imo"),
)
WEATHER_RULE = MergeRule(
    keys=("grid_id",),
    mutable=("temperature", "wind_speed", "wind_direction", "wave_height", "visibility", "pressure", "humidity",
             "sea_state", "ts"),
    fixed=("latitude", "longitude"),
)
PORT_OPERATION_RULE = MergeRule(
    keys=("operation_id",),
    mutable=("status", "departure_time"),
    fixed=("port_id", "port_name", "mmsi", "vessel_name", "operation_type", "berth_number", "arrival_time", "ts"),
)
ALERT_RULE = MergeRule(
    keys=("alert_id",),
    mutable=(),
    fixed=("alert_type", "severity", "mmsi", "vessel_name", "latitude", "longitude", "title", "description", "ts"),
)


class CurrentTable:
    """A keyed current-state table on plain files.

    Every batch is reduced to one row per key and written under its own batch id; a replay finds its complete folder
    and leaves it alone, so readers never miss one. Readers fold the newest base with the later batches. After every
    ``COMPACT_EVERY`` batches :meth:`compact` writes a new base, records it only when it is complete, and removes what
    lies before the base that was in use until then, so the number of folders stays bounded.
    """

    def __init__(self, spark: SparkSession, path: str, rule: MergeRule, row_schema: StructType):
        self.spark, self.path, self.rule = spark, path.rstrip("/"), rule
        empty = rule.reduced(spark.createDataFrame([], row_schema))
        self.schema = empty.schema
        for part in ("batches", "bases"):
            empty.withColumn("id", F.lit(-1).cast("bigint")).write.mode("append").partitionBy("id").parquet(
                f"{self.path}/{part}"
            )
        spark.createDataFrame([], "upto bigint").write.mode("append").parquet(f"{self.path}/versions")

    def _part(self, name: str) -> DataFrame:
        schema = StructType(list(self.schema.fields)).add("id", LongType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _version(self) -> int:
        versions = self.spark.read.schema("upto bigint").parquet(f"{self.path}/versions")
        return versions.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def upsert(self, rows: DataFrame, batch_id: int, compact: bool = True) -> None:
        """Write a batch; without ``compact`` that is left to a later :meth:`compact_if_due`."""
        folder = f"{self.path}/batches/id={int(batch_id)}"
        if not exists(self.spark, f"{folder}/_SUCCESS"):
            self.rule.reduced(rows, batch_id).write.mode("overwrite").parquet(folder)
        if compact:
            self.compact_if_due(batch_id)

    def compact_if_due(self, batch_id: int) -> None:
        if batch_id - self._version() >= COMPACT_EVERY:
            self.compact(batch_id)

    def state(self, upto: int | None = None) -> DataFrame:
        """The merged rows of all batches, or of those up to ``upto``, which no compaction may have passed."""
        version = self._version()
        base = self._part("bases").where(F.col("id") == version)
        later = self._part("batches").where(F.col("id") > version)
        return self.rule.merged([base, later if upto is None else later.where(F.col("id") <= upto)])

    def read(self, upto: int | None = None) -> DataFrame:
        return self.rule.plain(self.state(upto))

    def compact(self, upto: int) -> None:
        version = self._version()
        base = self._part("bases").where(F.col("id") == version)
        later = self._part("batches").where((F.col("id") > version) & (F.col("id") <= upto))
        self.rule.merged([base, later]).write.mode("overwrite").parquet(f"{self.path}/bases/id={int(upto)}")
        self.spark.createDataFrame([(int(upto),)], "upto bigint").coalesce(1).write.mode("append").parquet(
            f"{self.path}/versions"
        )
        for part, last in (("batches", version), ("bases", version - 1)):
            for name in children(self.spark, f"{self.path}/{part}"):
                if name.startswith("id=") and 0 <= int(name[3:]) <= last:
                    remove(self.spark, f"{self.path}/{part}/{name}")


def with_history_columns(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Whole-second time, day and month of a history row."""
    second = F.date_trunc("second", ts)
    return rows.withColumns({ts: second, "date": F.to_date(second), "ym": times.month_key(second)})


def append_history(rows: DataFrame, path: str, batch_id: int, order: Sequence[str] = ("mmsi", "ts")) -> None:
    """Append a batch to a monthly partitioned history; writing the same batch again replaces it.

    Rows are ranged over the sort key, so files are evenly sized also when one vessel or month dominates, and
    row groups can be skipped on it.
    """
    dated = with_history_columns(rows).withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
    (
        dated.repartitionByRange("ym", *order)
        .sortWithinPartitions("ym", *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ym", "batch_id")
        .parquet(path)
    )


# Years of history kept.
RETENTION_YEARS = {"positions": 2, "alerts": 3, "weather": 1, "port_operations": 2}
# Life of a latest value, in seconds, and of a per-key id set.
VALUE_SECONDS = {"positions": 300, "alerts": 3600, "weather": 1800, "port_operations": 600}
SET_SECONDS = {"alerts": 3600, "port_operations": 600}


def retained(rows: DataFrame, as_of: Column, years: int, ts: str = "ts") -> DataFrame:
    """Rows whose day is within the retention; on a history table whole months are pruned first."""
    oldest = F.add_months(F.to_date(as_of), -12 * years)
    kept = rows.where(F.to_date(ts) >= oldest)
    return kept.where(F.col("ym") >= times.month_key(oldest)) if "ym" in rows.columns else kept


def drop_expired_months(spark: SparkSession, path: str, as_of: dt.date, years: int) -> list[str]:
    """Delete the month folders of a history that lie wholly outside the retention; returns their names.

    The days of the month on the edge are left to :func:`retained`.
    """
    oldest = (as_of.year - years) * 100 + as_of.month
    gone = [n for n in children(spark, path) if n.startswith("ym=") and n[3:].isdigit() and int(n[3:]) < oldest]
    for name in gone:
        remove(spark, f"{path}/{name}")
    return gone


def compact_month(spark: SparkSession, path: str, ym: int, order: Sequence[str] = ("mmsi", "ts")) -> None:
    """Rewrite the batches of a closed month as one sorted set of files, under the month's highest batch id.

    The new files and the list of the batches in them are complete before the old folders go. After a failure a complete
    staging folder is never written again: the next call removes what is left of the listed batches and puts it in their
    place. Until then rows whose folder is gone are only in the staging folder. Batches that came later stay as they are.
    """
    month = f"{path}/ym={int(ym)}"
    staged, listed = f"{path}/_compact-{int(ym)}", f"{path}/_compact-{int(ym)}-batches"
    if not exists(spark, f"{staged}/_SUCCESS"):
        batches = [n for n in children(spark, month) if n.startswith("batch_id=")]
        if len(batches) < 2:
            return
        spark.createDataFrame([(n,) for n in batches], "name string").coalesce(1).write.mode("overwrite").parquet(listed)
        rows = spark.read.parquet(*[f"{month}/{n}" for n in batches])
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(staged)
    elif not exists(spark, f"{listed}/_SUCCESS"):
        raise ValueError(f"{staged} is complete, but the list of its batches is missing")
    batches = [r["name"] for r in spark.read.schema("name string").parquet(listed).collect()]
    for name in batches:
        remove(spark, f"{month}/{name}")
    rename(spark, staged, f"{month}/{max(batches, key=lambda n: int(n.split('=')[1]))}")
    remove(spark, listed)


def live_values(rows: DataFrame, keys: Sequence[str], as_of: Column, seconds: int) -> DataFrame:
    """Latest row per key, while it is younger than its life."""
    latest = sequence.latest_per_key(rows, list(keys))
    return latest.where(F.unix_millis(as_of) - F.unix_millis("ts") < seconds * 1000)


def live_members(
    rows: DataFrame, key: str, member: str, as_of: Column, seconds: int, slice_seconds: float = sequence.SLICE_SECONDS
) -> DataFrame:
    """Members of the id set of each key, where every addition renews the life of the whole set.

    One row per (key, member): a set may be as large as it likes.
    """
    life = seconds * 1000
    added = rows.select(key, member, "ts", "seq").where(F.col("ts") <= as_of)
    linked = sequence.with_previous(added, ["ts"], keys=[key], seconds=slice_seconds)
    reborn = F.col("prev").isNull() | (F.unix_millis("ts") - F.unix_millis("prev.ts") >= life)
    sets = (
        linked.groupBy(key)
        .agg(F.max(F.when(reborn, F.col("ts"))).alias("born_at"), F.max("ts").alias("_last"))
        .where(F.unix_millis("_last") + life > F.unix_millis(as_of))
        .select(key, "born_at", F.timestamp_millis(F.unix_millis("_last") + life).alias("expires_at"))
    )
    joined = skew.join_dimension(added, sets, [key], spread=[F.col(member)], how="inner")
    return joined.where(F.col("ts") >= F.col("born_at")).select(key, member, "expires_at").distinct()
