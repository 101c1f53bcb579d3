"""Keyed state in buckets of keys: a stateful step is called once per bucket and micro-batch, not once per key.

A call costs tens of milliseconds, whatever it does. So vessels are dealt to a fixed number of buckets, the state of a bucket is one
table, and a call works on all its vessels at once, in numpy. The number is part of a query's checkpoint, as is the number of
state partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

BUCKETS = 256
#: Stands for a null number on the way through pandas, where a null would turn whole columns into doubles. It sorts first, as null does.
NO_NUMBER = -(1 << 63)

KINDS = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
    "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC"),
}


def by_bucket(rows: DataFrame, key: str = "mmsi") -> GroupedData:
    """Rows grouped by the bucket of their key; null keys and numbers travel as ``NO_NUMBER``."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    whole = {c: F.coalesce(F.col(c), F.lit(NO_NUMBER)) for c in (key, "seq") if c in rows.columns}
    return rows.withColumn("bucket", bucket).withColumns(whole).groupBy("bucket")


def nulled(name: str) -> Column:
    """A number that travelled through :func:`by_bucket`."""
    return F.nullif(F.col(name), F.lit(NO_NUMBER))


def schema_of(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], KINDS[c.split()[1].lower()]) for c in ddl.split(", ")])


def table_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class TableState:
    """The state table of a bucket, with the columns of ``ddl``.

    With a ``ttl_ms`` rows count until that long after their ``touched_ms``, which :meth:`put` sets for the keys in ``touched``.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, ddl: str, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms
        self.schema = schema_of(ddl if ttl_ms is None else f"{ddl}, touched_ms bigint")
        self.value = handle.getValueState(name, "rows binary", ttlDurationMs=ttl_ms)

    def get(self, now_ms: int) -> pd.DataFrame:
        held = self.value.get()
        table = self.schema.empty_table() if held is None else table_of(bytes(held[0]))
        frame = table.to_pandas()
        return frame if self.ttl_ms is None else frame[frame["touched_ms"] + self.ttl_ms > now_ms].reset_index(drop=True)

    def put(self, rows: pd.DataFrame, now_ms: int, touched: np.ndarray | None = None) -> None:
        if not len(rows):
            self.value.clear()
            return
        if self.ttl_ms is not None:
            renewed = rows["mmsi"].isin(touched) if touched is not None else np.full(len(rows), True)
            before = rows["touched_ms"] if "touched_ms" in rows else now_ms
            rows = rows.assign(touched_ms=np.where(renewed, now_ms, before).astype("int64"))
        table = pa.Table.from_pandas(rows[self.schema.names], schema=self.schema, preserve_index=False).replace_schema_metadata(None)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(table)
        self.value.update((out.getvalue().to_pybytes(),))


def in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one bucket in one micro-batch, by vessel and time; their number is bounded by the trigger's intake."""
    parts = list(batches)
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    order = np.lexsort((pdf["seq"].to_numpy(), pdf["ts_us"].to_numpy(), pdf["mmsi"].to_numpy()))
    return pdf.take(order).reset_index(drop=True)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ordered keys are the first of their run, and which the last."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    differs = keys[1:] != keys[:-1]
    return np.append(True, differs), np.append(differs, True)


def one_timer(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    """Have the bucket called at that time and at no other."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if at_ms is not None:
        handle.registerTimer(int(at_ms))
