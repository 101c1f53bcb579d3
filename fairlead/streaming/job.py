"""Streaming jobs: topics in, topics and tables out."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fairlead.operators import detect, proximity, skew, tables, validate
from fairlead.operators.rollups import Rollup
from fairlead.session import children, exists, remove, touch
from fairlead.sources import files, wire
from fairlead.streaming import state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "5 seconds"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster with the settings that stateful queries need; the caller's stays as it is."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # The number of state partitions is fixed by the first run of a query, and is not adapted at run time.
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return session


def event_time(messages: DataFrame, arrived: str = "arrived") -> DataFrame:
    """Event time = message time, else arrival time; rows with neither are not usable and go out."""
    timed = messages.withColumn("ts", F.coalesce("ts", arrived)) if arrived in messages.columns else messages
    return timed.where(F.col("ts").isNotNull()).withWatermark("ts", LATENESS)


def alerts_of(rows: DataFrame) -> DataFrame:
    """Alert rows of the enriched positions that raised one."""
    return detect.speed_alert_rows(rows.where(F.col("alert_type").isNotNull()))


def together(spark: SparkSession, tasks: dict[str, Callable[[], None]]) -> None:
    """Run Spark jobs side by side, each in a scheduler pool of its name; all end before the first error is raised."""

    def named(name: str, task: Callable[[], None]) -> Callable[[], None]:
        def run() -> None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            task()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(len(tasks)) as pool:
        started = [pool.submit(named(name, task)) for name, task in tasks.items()]
    for done in started:
        done.result()


@dataclass
class Sinks:
    """Hands every micro-batch to several sinks at once and shows it to readers when all of them are complete.

    The batch is staged first, so the stateful steps before it run once, whatever becomes of executors. Every sink keys
    its write by the batch id and a replay replaces it; a batch is visible from the moment its mark is there, which is
    the highest complete batch id, as batches come one after the other. What an unmarked batch wrote is not read.
    """

    folder: str

    def tasks(self, rows: DataFrame, batch_id: int) -> dict[str, Callable[[], None]]:
        """The writes of a batch by the name of the sink."""
        raise NotImplementedError

    def shown(self, spark: SparkSession, batch_id: int) -> None:
        """Called when the batch is visible."""

    def write(self, rows: DataFrame, batch_id: int) -> None:
        spark, staged = rows.sparkSession, f"{self.folder}/_staged/{int(batch_id)}"
        # Also where a batch is delivered again: the state of the steps before it must move in every run.
        rows.write.mode("overwrite").parquet(staged)
        if batch_id > self.visible(spark):
            held = spark.read.schema(rows.schema).parquet(staged)
            together(spark, self.tasks(held, batch_id))
            touch(spark, f"{self.folder}/_visible/{int(batch_id)}")
        self.shown(spark, batch_id)
        remove(spark, staged)
        for name in children(spark, f"{self.folder}/_visible"):
            if name.isdigit() and int(name) < batch_id:
                remove(spark, f"{self.folder}/_visible/{name}")

    def visible(self, spark: SparkSession) -> int:
        """The highest batch id that readers see; -1 before the first."""
        return max((int(n) for n in children(spark, f"{self.folder}/_visible") if n.isdigit()), default=-1)

    def history(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}").where(F.col("batch_id") <= self.visible(spark))

    def topic(self, spark: SparkSession, name: str) -> DataFrame:
        """(key, value) of a topic that is kept in files."""
        rows = spark.read.schema("key string, value string, batch_id long").json(f"{self.folder}/{name}")
        return rows.where(F.col("batch_id") <= self.visible(spark)).drop("batch_id")


@dataclass
class PositionSinks(Sinks):
    """Where enriched positions go: two topics, two histories, and the current state."""

    current: tables.CurrentTable | None = None
    servers: str | None = None
    #: Vessel master, from which arrival time and draught of the current state come.
    master: DataFrame | None = None

    def tasks(self, rows: DataFrame, batch_id: int) -> dict[str, Callable[[], None]]:
        alerts = alerts_of(rows)

        def topic(messages: DataFrame, name: str) -> Callable[[], None]:
            return lambda: files.publish(messages, name, batch_id, servers=self.servers, directory=self.folder)

        found = {
            "vessel-positions": topic(wire.to_topic(rows, wire.POSITION_NAMES), "vessel-positions"),
            "vessel-alerts": topic(wire.to_topic(alerts, wire.ALERT_NAMES), "vessel-alerts"),
            "positions_history": lambda: tables.append_history(rows.drop("prev", "alert_type"), f"{self.folder}/positions_history", batch_id),
            "alerts_history": lambda: tables.append_history(alerts, f"{self.folder}/alerts_history", batch_id),
        }
        if self.current is not None:
            found["current"] = lambda: self.current.upsert(as_current(rows, self.master), batch_id, compact=False)
        return found

    def shown(self, spark: SparkSession, batch_id: int) -> None:
        if self.current is not None:
            self.current.compact_if_due(batch_id)

    def latest(self, spark: SparkSession) -> DataFrame:
        return self.current.read(self.visible(spark))


@dataclass
class PersistenceSinks(Sinks):
    """One topic's persistence: current state by the table's merge rule, and monthly history."""

    name: str = ""
    current: tables.CurrentTable | None = None
    order: tuple[str, ...] = ()

    def tasks(self, rows: DataFrame, batch_id: int) -> dict[str, Callable[[], None]]:
        return {
            f"{self.name}-current": lambda: self.current.upsert(rows, batch_id, compact=False),
            f"{self.name}-history": lambda: tables.append_history(rows, f"{self.folder}/{self.name}_history", batch_id, self.order),
        }

    def shown(self, spark: SparkSession, batch_id: int) -> None:
        self.current.compact_if_due(batch_id)

    def latest(self, spark: SparkSession) -> DataFrame:
        return self.current.read(self.visible(spark))


#: Merge rule, history order and wire names of the topics beside positions. Alerts are inserted once: all their columns are fixed.
PERSISTED = {
    "alerts": (tables.ALERT_RULE, ("mmsi", "ts"), wire.STORED_ALERT_NAMES),
    "weather": (tables.WEATHER_RULE, ("grid_id", "ts"), wire.WEATHER_NAMES),
    "port_operations": (tables.PORT_OPERATION_RULE, ("port_id", "ts"), wire.PORT_OPERATION_NAMES),
}


def persistence_sinks(spark: SparkSession, topic: str, folder: str, rows: DataFrame) -> PersistenceSinks:
    """Sinks of one of the PERSISTED topics, for rows of the shape of ``rows``."""
    rule, order, _ = PERSISTED[topic]
    return PersistenceSinks(folder, topic, tables.CurrentTable(spark, f"{folder}/{topic}", rule, rows.schema), order)


def consumed(messages: DataFrame, topic: str, kinds: dict[str, str]) -> DataFrame:
    """Typed rows of one of the PERSISTED topics out of its message texts, as its persistence job stores them."""
    return wire.from_topic(messages.select("value"), PERSISTED[topic][2], kinds)


def run_persistence(rows: DataFrame, sinks: PersistenceSinks, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return run_batches(rows, sinks.write, checkpoint, every=every)


def as_current(rows: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """Enriched positions with the columns of the current-state table; eta and draught are those of the master."""
    if master is None:
        rows = rows.withColumns({"eta": F.lit(None).cast("timestamp"), "draught": F.lit(None).cast("double")})
    else:
        known = master.select("mmsi", "eta", "draught")
        rows = skew.join_dimension(rows.drop("eta", "draught"), known, ["mmsi"], spread=[F.col("seq")])
    return rows.select(*tables.POSITION_RULE.keys, *tables.POSITION_RULE.mutable, *tables.POSITION_RULE.fixed, "seq")


def run_batches(
    rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``write``; without ``every`` it stops at the end of the input."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def valid_positions(rows: DataFrame, as_of: Column, check_age: bool = True) -> DataFrame:
    tagged = validate.with_reject_reason(rows, as_of, check_age=check_age)
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")


def run_positions(
    positions: DataFrame, sinks: PositionSinks, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Enrich and watch a stream of valid positions, and fan every batch out to topics and tables."""
    return run_batches(state.enriched_stream(positions), sinks.write, checkpoint, every=every)


def run_rejects(tagged: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Dead letters: the rejected rows of a stream with their reason."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rejects/batch_id={batch_id}")

    return run_batches(tagged.where(F.col("reject_reason").isNotNull()), write, checkpoint, every=every)


@dataclass
class RollupSink:
    """Keeps the mergeable state of every batch; readers fold them, so a row counts however late it comes.

    A replay of a complete batch changes nothing. Every ``tables.COMPACT_EVERY`` batches the states are folded into a
    base, and what an older base already holds is removed.
    """

    path: str
    rollup: Rollup

    def write(self, rows: DataFrame, batch_id: int) -> None:
        spark, folder = rows.sparkSession, f"{self.path}/batches/id={int(batch_id)}"
        if not exists(spark, f"{folder}/_SUCCESS"):
            self.rollup.state(rows).write.mode("overwrite").parquet(folder)
        base = self._base(spark)
        if batch_id - base >= tables.COMPACT_EVERY:
            self.state(spark, upto=batch_id).write.mode("overwrite").parquet(f"{self.path}/bases/id={int(batch_id)}")
            for part, last in (("batches", base), ("bases", base - 1)):
                for number in self._done(spark, part):
                    if number <= last:
                        remove(spark, f"{self.path}/{part}/id={number}")

    def _done(self, spark: SparkSession, part: str) -> list[int]:
        names = [n for n in children(spark, f"{self.path}/{part}") if n.startswith("id=")]
        return sorted(int(n[3:]) for n in names if exists(spark, f"{self.path}/{part}/{n}/_SUCCESS"))

    def _base(self, spark: SparkSession) -> int:
        return max(self._done(spark, "bases"), default=-1)

    def state(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        base = self._base(spark)
        held = [f"bases/id={base}"] if base >= 0 else []
        later = [n for n in self._done(spark, "batches") if n > base and (upto is None or n <= upto)]
        return self.rollup.merged([spark.read.parquet(*[f"{self.path}/{p}" for p in held + [f"batches/id={n}" for n in later]])])

    def read(self, spark: SparkSession) -> DataFrame:
        return self.rollup.finished(self.state(spark))


def run_rollup(
    rows: DataFrame, sink: RollupSink, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Maintain a rollup as rows come in. No state is held between batches, so no row is ever too late."""
    return run_batches(rows, sink.write, checkpoint, every=every)


def proximity_stream(positions: DataFrame) -> DataFrame:
    """Latest fix per vessel and sliding window, handed on when the window is over.

    All fixes of a window leave in one batch, so pairs are found batch by batch with the same join as at rest.
    """
    return proximity.window_fixes(positions.withWatermark("ts", LATENESS))
