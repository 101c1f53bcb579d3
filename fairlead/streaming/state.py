"""Stateful processors: the streaming twins of the per-vessel sequence operators.

Python only keeps the carried values and the throttle clock. Distances, texts and all other columns are
computed by the same Column expressions as in batch, after the state step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fairlead.functions import geo, vessel
from fairlead.operators import detect, throttle
from fairlead.streaming import buckets

# How late a fix may come and still find the fix before it.
RECENT_MS = 300_000
PREVIOUS = {"latitude": "double", "longitude": "double", "speed": "double", "course": "double"}


class Previous(StatefulProcessor):
    """Adds ``prev_*`` columns of the preceding row of the vessel, to all vessels of a bucket at once.

    The state holds the newest row of a vessel and those up to ``recent_ms`` before it, so a row that comes late by no more
    than that finds the row before it. A row older than all that is held has no previous row.
    """

    def __init__(self, carried: dict[str, str], ttl_ms: int | None = None, recent_ms: int = RECENT_MS):
        self.carried = carried
        self.ttl_ms = ttl_ms
        self.recent_ms = recent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = _ddl({"mmsi": "bigint", **self.carried, "ts_us": "bigint", "seq": "bigint"})
        self.recent = buckets.TableState(handle, "recent", held, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = buckets.in_order(rows)
        yield pdf.assign(**self.previous_columns(pdf, timerValues.getCurrentProcessingTimeInMs()))

    def previous_columns(self, pdf: pd.DataFrame, now_ms: int) -> dict[str, pd.Series]:
        """The previous values of the ordered rows of one micro-batch; the state moves on."""
        names = [*self.carried, "ts_us"]
        held = self.recent.get(now_ms)
        both = pd.concat([held, pdf[["mmsi", *names, "seq"]]], ignore_index=True) if len(held) else pdf[["mmsi", *names, "seq"]]
        ts, mmsi = both["ts_us"].to_numpy(), both["mmsi"].to_numpy()
        # Of a row that is delivered again the held one comes first.
        order = np.lexsort((np.arange(len(both)) >= len(held), both["seq"].to_numpy(), ts, mmsi))
        first, last = buckets.runs(mmsi[order])
        before = np.full(len(both), -1)
        before[order[1:]] = np.where(first[1:], -1, order[:-1])
        before = before[len(held) :]
        columns = {f"prev_{c}": both[c].reindex(before).reset_index(drop=True) for c in names}
        columns["prev_ts_us"] = columns["prev_ts_us"].astype("Int64")
        newest = ts[order][last][np.cumsum(first) - 1]
        kept = both.take(order[ts[order] >= newest - self.recent_ms * 1000])
        self.recent.put(kept, now_ms, pdf["mmsi"].unique())
        return columns

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Start from the newest rows of the vessels as a table has them, once, in a run without a checkpoint."""
        now = timerValues.getCurrentProcessingTimeInMs()
        given = initialState[["mmsi", *self.carried, "ts_us", "seq"]]
        self.recent.put(pd.concat([self.recent.get(now), given], ignore_index=True), now, given["mmsi"].unique())

    def close(self) -> None:
        pass


class PreviousAndThrottle(Previous):
    """Also names the alert that passes the throttle for each row, in ``alert_type``."""

    def __init__(self, carried: dict[str, str], interval_ms: int, ttl_ms: int | None = None):
        super().__init__(carried, ttl_ms)
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.clock = buckets.TableState(handle, "clock", "mmsi bigint, alerted_ms bigint", self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        super().handleInitialState(key, initialState, timerValues)
        alerted = initialState.drop_duplicates("mmsi").dropna(subset=["alerted_ms"])[["mmsi", "alerted_ms"]]
        now = timerValues.getCurrentProcessingTimeInMs()
        self.clock.put(pd.concat([self.clock.get(now), alerted], ignore_index=True), now, alerted["mmsi"].unique())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, now = buckets.in_order(rows), timerValues.getCurrentProcessingTimeInMs()
        columns = self.previous_columns(pdf, now)
        speed = pdf["speed"].to_numpy(dtype=float)
        before = columns["prev_speed"].to_numpy(dtype=float)
        ms = pdf["ts_us"].to_numpy() // 1000
        elapsed = ms - columns["prev_ts_us"].to_numpy(dtype=float, na_value=np.nan) // 1000
        with np.errstate(divide="ignore", invalid="ignore"):
            acceleration = np.where(elapsed != 0, np.abs(speed - before) / (elapsed / 1000.0), np.nan)
            met = [
                (detect.EXCESSIVE, ~np.isnan(before) & (speed > pdf["top_speed"].to_numpy() * detect.SPEED_FACTOR)),
                (detect.STOP, (before > detect.STOP_FROM_KN) & (speed < detect.STOP_BELOW_KN)),
                (detect.ACCELERATION, acceleration > detect.MAX_ACCELERATION_KN_S),
            ]
        kind = np.full(len(pdf), None, dtype=object)
        for name, mask in reversed(met):
            kind[mask] = name
        candidates = np.flatnonzero(kind != None)  # noqa: E711 - elementwise
        alerts = np.full(len(pdf), None, dtype=object)
        if len(candidates):
            passed = self.passed(pdf["mmsi"].to_numpy()[candidates], ms[candidates], now)
            alerts[candidates[passed]] = kind[candidates[passed]]
        yield pdf.assign(**columns, alert_type=alerts)

    def passed(self, mmsi: np.ndarray, ms: np.ndarray, now_ms: int) -> list[int]:
        """Which candidates, ordered by vessel and time, pass; the clock moves on."""
        clock = self.clock.get(now_ms)
        alerted = dict(zip(clock["mmsi"].tolist(), clock["alerted_ms"].tolist(), strict=True))
        starts = np.flatnonzero(buckets.runs(mmsi)[0]).tolist()
        found, moved = [], {}
        for start, end in zip(starts, [*starts[1:], len(ms)], strict=True):
            vessel_ = int(mmsi[start])
            release = alerted[vessel_] + self.interval_ms if vessel_ in alerted else throttle.NEVER
            own = throttle.survivors(ms[start:end], release, self.interval_ms)
            if own:
                found += [start + i for i in own]
                moved[vessel_] = int(ms[found[-1]])
        if moved:
            new = pd.DataFrame({"mmsi": list(moved), "alerted_ms": list(moved.values())}, dtype="int64")
            rest = clock[~clock["mmsi"].isin(list(moved))]
            self.clock.put(pd.concat([rest, new], ignore_index=True) if len(rest) else new, now_ms, new["mmsi"].to_numpy())
        return found


class LatestValue(StatefulProcessor):
    """The latest value of every vessel of a bucket, in state while it is younger than its life on the event-time clock.

    Nothing is handed on; the values are read from the state store, see :func:`live_values`.
    """

    def __init__(self, value: str, life_ms: int):
        self.value, self.life_ms = value, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = buckets.TableState(handle, "latest", f"mmsi bigint, {self.value}, ts_us bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, held = buckets.in_order(rows)[self.latest.schema.names], self.latest.get(0)
        yield self.moved(pd.concat([held, new], ignore_index=True) if len(held) else new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.moved(self.latest.get(0), timerValues)

    def moved(self, rows: pd.DataFrame, timerValues) -> pd.DataFrame:
        """Keep the last of the rows of each vessel, of equal ones that which came last, as long as it lives."""
        mmsi = rows["mmsi"].to_numpy()
        order = np.lexsort((rows["seq"].to_numpy(), rows["ts_us"].to_numpy(), mmsi))
        rows = rows.take(order[buckets.runs(mmsi[order])[1]])
        end_ms = rows["ts_us"].to_numpy(dtype="int64") // 1000 + self.life_ms
        alive = end_ms >= timerValues.getCurrentWatermarkInMs()
        self.latest.put(rows[alive], 0)
        buckets.one_timer(self.handle, end_ms[alive].min() if alive.any() else None)
        return pd.DataFrame({"mmsi": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


# Columns that travel through the state step, with the type they travel as.
TRAVELLING = {
    "mmsi": "bigint", "vessel_name": "string", "imo": "string", "call_sign": "string", "latitude": "double",
    "longitude": "double", "speed": "double", "course": "double", "heading": "double",
    "navigation_status": "double", "status": "string", "source": "string", "vessel_type": "string",
    "top_speed": "double", "ts_us": "bigint", "seq": "bigint",
}


def _travelling(positions: DataFrame) -> DataFrame:
    ready = positions.withColumns(
        {
            "vessel_type": vessel.type_from_name(F.col("vessel_name")),
            "ts_us": F.unix_micros("ts"),
        }
    ).withColumn("top_speed", vessel.top_speed(F.col("vessel_type")))
    return ready.select(*[F.col(c).cast(kind).alias(c) for c, kind in TRAVELLING.items()])


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in columns.items())


#: What a run without its checkpoint starts from: the newest fix of every vessel and its last alert.
INITIAL = "mmsi bigint, latitude double, longitude double, speed double, course double, ts_us bigint, seq bigint, alerted_ms bigint"


def initial_state(positions: DataFrame, alerts: DataFrame) -> DataFrame:
    """The INITIAL rows out of stored positions and alerts (mmsi, ts), which must be as old as the stream is to go on from."""
    newest = F.max_by(F.struct("latitude", "longitude", "speed", "course", F.unix_micros("ts").alias("ts_us"), "seq"), F.struct("ts", "seq")).alias("n")
    last = positions.groupBy("mmsi").agg(newest).select("mmsi", "n.*")
    alerted = alerts.groupBy("mmsi").agg(F.max(F.unix_millis("ts")).alias("alerted_ms"))
    return last.join(alerted, "mmsi", "left").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in INITIAL.split(", ")])


def enriched_stream(
    positions: DataFrame, interval_ms: int = throttle.INTERVAL_MS, ttl_ms: int | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """Valid positions of a stream with ``prev``, movement columns and the ``alert_type`` that passed, if any.

    One stateful operator and one exchange do both enrichment and detection. ``initial`` rows (see
    :func:`initial_state`) stand for a lost checkpoint.
    """
    out = {**TRAVELLING, **{f"prev_{c}": k for c, k in PREVIOUS.items()}, "prev_ts_us": "bigint",
           "alert_type": "string"}
    rows = buckets.by_bucket(_travelling(positions)).transformWithStateInPandas(
        PreviousAndThrottle(PREVIOUS, interval_ms, ttl_ms),
        outputStructType=_ddl(out),
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
        initialState=None if initial is None else buckets.by_bucket(initial),
    )
    prev = F.struct(
        *[F.col(f"prev_{c}").alias(c) for c in PREVIOUS], F.timestamp_micros("prev_ts_us").alias("ts")
    )
    rows = rows.withColumns(
        {
            "mmsi": buckets.nulled("mmsi"),
            "seq": buckets.nulled("seq"),
            "heading": F.col("heading").cast("int"),
            "navigation_status": F.col("navigation_status").cast("int"),
            "ts": F.timestamp_micros("ts_us"),
            "prev": F.when(F.col("prev_ts_us").isNotNull(), prev),
        }
    )
    moved = rows.withColumns(
        {
            "distance_from_previous": geo.distance_nm(
                F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude")
            ),
            "time_since_last_update": F.unix_millis("ts") - F.unix_millis("prev.ts"),
            "flag": F.lit("ID"),
            "destination": F.lit("Unknown"),
            "grid_cell": geo.position_cell(F.col("latitude"), F.col("longitude")),
            "validated": F.lit(True),
            "validation_status": F.lit("VALID"),
        }
    )
    return moved.drop("ts_us", "top_speed", "prev_ts_us", *[f"prev_{c}" for c in PREVIOUS])


def latest_stream(positions: DataFrame, value: str, life_seconds: int) -> DataFrame:
    """A stream that keeps the latest ``value`` ("name type, ...") of every vessel for its life, and has no rows."""
    names = [c.split()[0] for c in value.split(", ")]
    rows = positions.withWatermark("ts", "0 seconds").select("mmsi", *names, F.unix_micros("ts").alias("ts_us"), "seq")
    return buckets.by_bucket(rows).transformWithStateInPandas(
        LatestValue(value, life_seconds * 1000), outputStructType="mmsi bigint", outputMode="Append", timeMode="EventTime"
    )


def live_values(spark: SparkSession, checkpoint: str, value: str) -> DataFrame:
    """What a :func:`latest_stream` of that ``value`` holds, by the state reader: mmsi, the value, ts_us, seq."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "latest").load()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                yield from buckets.table_of(rows.as_py()).to_batches()

    rows = held.select("value.rows").mapInArrow(task, f"mmsi bigint, {value}, ts_us bigint, seq bigint")
    return rows.withColumns({c: buckets.nulled(c) for c in ("mmsi", "seq")})
