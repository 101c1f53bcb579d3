"""Tracks of a position stream: sessions kept in state, with their path length, and the rows that come too late."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fairlead.functions import geo
from fairlead.streaming import buckets

#: One fix as the state holds it, and the sum of the fixes before it that can get no new neighbours.
FIX = "ts_us bigint, seq bigint, latitude double, longitude double, speed double"
SESSION = f"start_us bigint, points bigint, distance_nm double, speed_sum double, speeds bigint, max_speed double, {FIX}"
OUT = (
    "mmsi bigint, late boolean, start_us bigint, end_us bigint, points bigint, distance_nm double, avg_speed double, "
    "max_speed double, ts_us bigint, seq bigint"
)


class Sessions(StatefulProcessor):
    """Runs of fixes of a vessel without a gap longer than ``gap_ms``, on whole milliseconds as at rest, for a bucket of vessels.

    Fixes behind the watermark can get no new neighbours, so they are folded, in time order, into the one session of their
    vessel that is open there; those ahead of it stay as they are and fall into place whatever the order they come in, so a
    late fix may lengthen, split off or bridge sessions. A session is handed on when the watermark has passed its end by the
    gap. A fix behind the watermark when it comes is not dropped but handed on as ``late``.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def apart(self, before_us: np.ndarray, us: np.ndarray | int) -> np.ndarray:
        return us // 1000 - before_us // 1000 > self.gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = buckets.TableState(handle, "open", f"mmsi bigint, {SESSION}")
        self.ahead = buckets.TableState(handle, "ahead", f"mmsi bigint, {FIX}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        late = new[new["ts_us"] < mark]
        fixes, held = new[new["ts_us"] >= mark][self.ahead.schema.names].astype({"ts_us": "int64"}), self.ahead.get(0)
        yield self.moved(pd.concat([held, fixes], ignore_index=True) if len(held) else fixes, mark, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        yield self.moved(self.ahead.get(0), mark, pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("mmsi", "ts_us", "seq")}))

    def moved(self, fixes: pd.DataFrame, mark: int, late: pd.DataFrame) -> pd.DataFrame:
        """Bring the state up to the watermark; the sessions that are over and the late rows."""
        behind = fixes["ts_us"].to_numpy() < mark
        found, held = _begun(fixes[behind]), self.open.get(0)
        sessions = self.folded(pd.concat([held, found], ignore_index=True) if len(held) else found)
        # The last session of a vessel stays open unless the watermark is past it.
        over = ~buckets.runs(sessions["mmsi"].to_numpy())[1] | self.apart(sessions["ts_us"].to_numpy(), mark)
        now, rest = sessions[~over], fixes[~behind]
        self.open.put(now, 0)
        self.ahead.put(rest, 0)
        ends = self.first_ends(now, rest)
        buckets.one_timer(self.handle, ends.min() // 1000 + self.gap_ms + 1 if len(ends) else None)
        done = sessions[over]
        speeds = done["speeds"].to_numpy()
        average = np.where(speeds > 0, done["speed_sum"] / np.maximum(speeds, 1), np.nan)
        out = done[["mmsi", "start_us", "points", "distance_nm", "max_speed"]].assign(late=False, end_us=done["ts_us"], avg_speed=average)
        frame = pd.concat([out, late[["mmsi", "ts_us", "seq"]].assign(late=True)], ignore_index=True)
        frame = frame.reindex(columns=[c.split()[0] for c in OUT.split(", ")]).astype({"late": "bool", "mmsi": "int64"})
        for c in ("start_us", "end_us", "points", "ts_us", "seq"):
            frame[c] = frame[c].astype("Int64")
        return frame

    def folded(self, parts: pd.DataFrame) -> pd.DataFrame:
        """Sessions out of parts of sessions that lie one after the other."""
        parts = parts.take(np.lexsort((parts["seq"].to_numpy(), parts["ts_us"].to_numpy(), parts["mmsi"].to_numpy()))).reset_index(drop=True)
        if not len(parts):
            return parts
        ts, (first, _) = parts["ts_us"].to_numpy(), buckets.runs(parts["mmsi"].to_numpy())
        first[1:] |= self.apart(ts[:-1], ts[1:])
        number, lat, lon = np.cumsum(first) - 1, parts["latitude"].to_numpy(), parts["longitude"].to_numpy()
        legs = np.zeros(len(parts))
        legs[1:] = np.where(first[1:], 0.0, np.nan_to_num(geo.great_circle_of(lat[:-1], lon[:-1], lat[1:], lon[1:], geo.EARTH_RADIUS_NM)))
        ends = parts[np.append(first[1:], True)].reset_index(drop=True)
        return ends.assign(
            start_us=parts["start_us"].to_numpy()[first],
            points=np.bincount(number, parts["points"]).astype("int64"),
            distance_nm=np.bincount(number, parts["distance_nm"] + legs),
            speed_sum=np.bincount(number, parts["speed_sum"]),
            speeds=np.bincount(number, parts["speeds"]).astype("int64"),
            max_speed=np.fmax.reduceat(parts["max_speed"].to_numpy(), np.flatnonzero(first)),
        )

    def first_ends(self, now: pd.DataFrame, rest: pd.DataFrame) -> np.ndarray:
        """The end of the first session of every vessel, as far as it is known."""
        mmsi, ts = (np.concatenate([now[c].to_numpy(), rest[c].to_numpy()]) for c in ("mmsi", "ts_us"))
        order = np.lexsort((ts, mmsi))
        mmsi, ts = mmsi[order], ts[order]
        last = buckets.runs(mmsi)[1]
        last[:-1] |= self.apart(ts[:-1], ts[1:])
        mmsi, ts = mmsi[last], ts[last]
        return ts[buckets.runs(mmsi)[0]]

    def close(self) -> None:
        pass


def _begun(fixes: pd.DataFrame) -> pd.DataFrame:
    """A session of every fix alone."""
    speed = fixes["speed"]
    return fixes.assign(start_us=fixes["ts_us"], points=1, distance_nm=0.0, speed_sum=speed.fillna(0.0), speeds=speed.notna().astype("int64"), max_speed=speed)


def session_tracks(positions: DataFrame, gap_minutes: float, late: str) -> DataFrame:
    """Tracks that are over, and late rows (``late`` is true) with their time and number, of a stream of positions.

    ``late`` says how far behind the newest fix of the stream a fix may come and still count. Every fix that comes in is a
    point of one track or one late row.
    """
    # The event time stays out of what the step reads: Spark would drop rows behind the watermark without a word.
    fixes = positions.withWatermark("ts", late).select("mmsi", F.unix_micros("ts").alias("ts_us"), "seq", "latitude", "longitude", "speed")
    found = buckets.by_bucket(fixes).transformWithStateInPandas(
        Sessions(int(gap_minutes * 60_000)), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )
    instants = {"track_start": "start_us", "track_end": "end_us", "ts": "ts_us"}
    named = {name: F.timestamp_micros(us) for name, us in instants.items()} | {c: buckets.nulled(c) for c in ("mmsi", "seq")}
    return found.withColumns(named).drop(*instants.values())


def silence_stream(positions: DataFrame, gap_minutes: float, late: str) -> DataFrame:
    """Vessels that fell silent for longer than the gap, as soon as the watermark has passed it: mmsi, lost_at.

    A silence is what follows a session. Late rows (``late`` is true, with ``ts``) are told beside them.
    """
    return session_tracks(positions, gap_minutes, late).select("mmsi", F.col("track_end").alias("lost_at"), "late", "ts", "seq")
