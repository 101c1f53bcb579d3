"""Greedy alert throttle: a candidate passes when more than ``interval_ms`` went by since the last that passed.

The rule is sequential per key, yet no key is folded in one task. Every time slice of a key is turned into a
step function "release time on entry -> release time on exit"; step functions compose, so they are combined in
a tree of fixed fan-out and as many levels as the longest key needs, the release time on entry of every slice follows on the way back, and each slice then
picks its own survivors. Candidates of one millisecond are reduced to the first before anything is collected,
which bounds a slice by its milliseconds whatever the number of rows. Keys with few candidates, as most pairs of
vessels have, need no tree: their times are walked as one short array, without Python.

Candidates that come together (``TOGETHER``), as pairs of vessels can, are walked as they come and never stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.operators import skew
from fairlead.operators.sequence import SLICE, SLICE_SECONDS, with_slice
from fairlead.session import stored_table

INTERVAL_MS = 300_000
FAN_OUT = 64
# Candidates of a key that are walked as one array; keys with more of them take the tree.
FEW = 64
NEVER = -(2**62)

# Columns of candidates that come together: all of a key have one part and are in one task, which has the blocks of a part
# one after the other. No candidate of a block is earlier than one of a block before.
PART, BLOCK = "_part", "_block"
TOGETHER = (PART, BLOCK)
# Candidates that are walked at once, if whole blocks have no more.
WALK_ROWS = 100_000

STEPS = "struct<bounds: array<bigint>, exits: array<bigint>>"


def slice_steps(ms: np.ndarray, horizon: int, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of one slice.

    ``ms`` are distinct ascending candidate times. On entry with release time r the first candidate after r
    passes, and so on; the exit is the release time after the last that passed. Entries at or beyond the last
    bound leave r unchanged. Only entries below ``horizon`` can occur.
    """
    n = len(ms)
    follower = np.searchsorted(ms, ms + interval, side="right")
    last = np.where(follower == n, np.arange(n), follower)
    while True:
        jumped = last[last]
        if np.array_equal(jumped, last):
            break
        last = jumped
    reachable = int(np.searchsorted(ms, horizon, side="left")) + 1
    return merge_equal(ms[:reachable], (ms[last] + interval)[:reachable])


def merge_equal(bounds: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join neighbouring steps that leave with the same release time."""
    if len(exits) < 2:
        return bounds, exits
    keep = np.append(exits[1:] != exits[:-1], True)
    return bounds[keep], exits[keep]


def apply_steps(release: np.ndarray, bounds: np.ndarray, exits: np.ndarray) -> np.ndarray:
    at = np.searchsorted(bounds, release, side="right")
    return np.where(at < len(bounds), exits[np.minimum(at, len(bounds) - 1)], release)


def compose(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One step function for several slices in time order."""
    bounds, exits = parts[0]
    for b, e in parts[1:]:
        tail = b > bounds[-1]
        bounds = np.concatenate([bounds, b[tail]])
        exits = np.concatenate([apply_steps(exits, b, e), e[tail]])
        bounds, exits = merge_equal(bounds, exits)
    return bounds, exits


def survivors(ms: np.ndarray, release: int, interval: int) -> list[int]:
    """Positions of the candidates of one slice that pass, given the release time on entry."""
    passed, at = [], int(np.searchsorted(ms, release, side="right"))
    while at < len(ms):
        passed.append(at)
        at = int(np.searchsorted(ms, ms[at] + interval, side="right"))
    return passed


def _parts(children) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(c["bounds"], dtype=np.int64), np.asarray(c["exits"], dtype=np.int64)) for c in children]


def _udfs(interval: int):
    @F.pandas_udf(STEPS)
    def steps_of(ms: pd.Series, horizon: pd.Series) -> pd.DataFrame:
        made = [slice_steps(np.asarray(m, dtype=np.int64), h, interval) for m, h in zip(ms, horizon)]
        return pd.DataFrame({"bounds": [b for b, _ in made], "exits": [e for _, e in made]})

    @F.pandas_udf(STEPS)
    def composed(children: pd.Series) -> pd.DataFrame:
        made = [compose(_parts(c)) for c in children]
        return pd.DataFrame({"bounds": [b for b, _ in made], "exits": [e for _, e in made]})

    @F.pandas_udf("array<bigint>")
    def entries(children: pd.Series, release: pd.Series) -> pd.Series:
        out = []
        for child, r in zip(children, release):
            at, walked = np.array([r], dtype=np.int64), []
            for bounds, exits in _parts(child):
                walked.append(int(at[0]))
                at = apply_steps(at, bounds, exits)
            out.append(walked)
        return pd.Series(out)

    @F.pandas_udf("array<bigint>")
    def passing(ms: pd.Series, release: pd.Series) -> pd.Series:
        times = [np.asarray(m, dtype=np.int64) for m in ms]
        return pd.Series([m[survivors(m, r, interval)] for m, r in zip(times, release)])

    return steps_of, composed, entries, passing


def tree_levels(slices_per_key: int, fan_out: int) -> int:
    """Levels between the slices and the root, so that no node has more than ``fan_out`` children."""
    levels = 0
    while fan_out ** (levels + 1) < slices_per_key:
        levels += 1
    return levels


def throttled(
    candidates: DataFrame,
    keys: Sequence[str] = ("mmsi",),
    *,
    interval_ms: int = INTERVAL_MS,
    order: Sequence[str] = ("seq",),
    ts: str = "ts",
    seconds: float = SLICE_SECONDS,
    fan_out: int = FAN_OUT,
    levels: int | None = None,
    few: int = FEW,
) -> DataFrame:
    """The candidates that pass; ``order`` breaks ties inside one millisecond. Same columns as the input.

    A slice column left by the sequence operators is reused, so throttling after them needs no further
    exchange of the candidates. The candidates, which are few beside the rows that they were found in, are written to
    the shared folder once, so detection runs once; only their distinct times are gathered, and the candidates that
    pass are picked by a join on their slice. Keys with at most ``few`` candidates are settled by :func:`_walked`.

    Candidates that come ``TOGETHER`` are neither exchanged nor written: what passes is picked as they come.
    """
    keys = list(keys)
    if all(c in candidates.columns for c in TOGETHER):
        return _streamed(candidates, keys, interval_ms, order, ts)
    sliced = stored_table(with_slice(candidates, seconds, ts).withColumn("_ms", F.unix_millis(ts)), "candidates")
    # Rows without a key or a time never pass.
    sliced = sliced.dropna(subset=[*keys, "_ms"])
    busy = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few).select(*keys)
    busy = stored_table(busy, "busy")
    chosen = _walked(skew.join_dimension(sliced, busy, keys, [F.col("_ms")], "left_anti"), keys, interval_ms)
    if busy.limit(1).count():
        held = skew.join_dimension(sliced, busy, keys, [F.col("_ms")], "left_semi")
        chosen = chosen.unionByName(_climbed(held, keys, interval_ms, fan_out, levels))
    # Of several candidates in one millisecond only the first passes.
    columns = [c for c in candidates.columns if c != SLICE and c not in keys]
    firsts = chosen.groupBy(*keys, "_ms").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return firsts.select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in candidates.columns if c != SLICE]
    )


def _walked(sliced: DataFrame, keys: list[str], interval_ms: int) -> DataFrame:
    """The rows of the times that pass, of keys with few rows each."""
    start = F.struct(F.lit(NEVER).cast("bigint").alias("release"), F.array().cast("array<bigint>").alias("passed"))
    gone = lambda held, ms: F.struct((ms + interval_ms).alias("release"), F.concat(held["passed"], F.array(ms)).alias("passed"))
    walk = F.aggregate("_times", start, lambda held, ms: F.when(ms > held["release"], gone(held, ms)).otherwise(held), lambda held: held["passed"])
    times = sliced.groupBy(*keys).agg(F.sort_array(F.collect_set("_ms")).alias("_times"))
    passed = times.select(*keys, walk.alias("_passed"))
    return sliced.join(passed, keys).where(F.array_contains("_passed", F.col("_ms"))).drop("_passed")


def _climbed(sliced: DataFrame, keys: list[str], interval_ms: int, fan_out: int, levels: int | None) -> DataFrame:
    """The rows of the times that pass, by the tree over the slices of every key."""
    steps_of, composed, entries, passing = _udfs(interval_ms)
    moments = sliced.select(*keys, SLICE, "_ms").distinct().groupBy(*keys, SLICE).agg(
        F.sort_array(F.collect_list("_ms")).alias("_times")
    )
    horizon = F.get("_times", F.lit(0)) + interval_ms
    # Read several times below, so it is written once instead of being worked out again for each use.
    slices = stored_table(moments.withColumn("_steps", steps_of(F.col("_times"), horizon)), "throttle")

    if levels is None:
        levels = tree_levels(slices.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1, fan_out)

    # Up: parents[l] holds, per key and node of level l + 1, the steps of its children in time order.
    parents, level = [], slices.select(*keys, F.col(SLICE).alias("_node"), "_steps")
    for height in range(levels + 1):
        node = F.expr(f"_node div {fan_out}") if height < levels else F.lit(0).cast("bigint")
        packed = (
            level.withColumn("_parent", node)
            .groupBy(*keys, "_parent")
            .agg(F.sort_array(F.collect_list(F.struct("_node", "_steps"))).alias("_children"))
        )
        parents.append(packed)
        if height < levels:
            level = packed.select(
                *keys, F.col("_parent").alias("_node"), composed(F.col("_children._steps")).alias("_steps")
            )

    # Down: the release time on entry of every node, from the whole key to the single slices.
    release = None
    for packed in reversed(parents):
        if release is None:
            walked = packed.withColumn("_release", F.lit(NEVER))
        else:
            walked = packed.join(release, [*keys, "_parent"])
        zipped = F.arrays_zip(
            F.col("_children._node").alias("node"),
            entries(F.col("_children._steps"), F.col("_release")).alias("entry"),
        )
        release = walked.select(*keys, F.explode(zipped).alias("_z")).select(
            *keys, F.col("_z.node").alias("_parent"), F.col("_z.entry").alias("_release")
        )

    passed = slices.join(release.withColumnRenamed("_parent", SLICE), [*keys, SLICE]).select(
        *keys, SLICE, passing(F.col("_times"), F.col("_release")).alias("_passed")
    )
    found = sliced.join(passed.where(F.size("_passed") > 0), [*keys, SLICE])
    return found.where(F.array_contains("_passed", F.col("_ms"))).drop("_passed")


def _streamed(candidates: DataFrame, keys: list[str], interval_ms: int, order: Sequence[str], ts: str) -> DataFrame:
    """The rows that pass, of candidates that come together; keys are whole numbers."""
    kept = candidates.drop(*TOGETHER)
    given = candidates.dropna(subset=[*keys, ts]).withColumn("_ms", F.unix_millis(ts))
    names, order = kept.columns, list(order)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock = PairClock(len(keys), interval_ms)
        for rows in whole_blocks(batches, WALK_ROWS):
            column = lambda c: rows.column(c).to_numpy()  # noqa: B023, E731
            passed = clock.passed([column(k) for k in keys], column("_ms"), [column(c) for c in order], *[column(c) for c in TOGETHER])
            yield from rows.select(names).take(pa.array(passed)).combine_chunks().to_batches()

    return given.mapInArrow(task, kept.schema)


def whole_blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """The rows of consecutive blocks, of as many as have ``least`` rows together; no block is divided."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        place = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in TOGETHER]
        if held and count >= least and any(held[-1].column(c)[-1].as_py() != p[0] for c, p in zip(TOGETHER, place, strict=True)):
            yield pa.Table.from_batches(held)
            held, count = [], 0
        if count + batch.num_rows > least:
            # The last block may go on in the next batch.
            begins = np.flatnonzero(np.logical_or.reduce([p[1:] != p[:-1] for p in place])) + 1
            if len(begins):
                yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
                held, count, batch = [], 0, batch.slice(begins[-1])
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


class PairClock:
    """The release times of the keys of a part, for candidates that come block by block.

    Keys are numbered by the ids that are known so far, so that a key of several ids is one number. A release time that lies
    before the block of the last call is forgotten, as is another part; what is held are the keys that passed in the last interval.
    """

    def __init__(self, width: int, interval: int):
        self.width, self.interval = width, interval
        self.ids = self.keys = self.release = np.zeros(0, dtype=np.int64)
        self.part, self.ms = None, None

    def passed(self, keys: Sequence[np.ndarray], ms: np.ndarray, order: Sequence[np.ndarray], part: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Which candidates of whole blocks pass; the clock moves on. A key has one part, so parts need no part of the number."""
        self._begin(ms, part, block)
        number = self._numbered(keys)
        at = np.lexsort((*reversed(order), ms, number))
        number, ms = number[at], ms[at]
        first = np.append(True, number[1:] != number[:-1])
        starts, of = np.flatnonzero(first), np.cumsum(first) - 1
        ends, own = np.append(starts[1:], len(ms)), number[starts]
        # Times of one key after those of the key before, so that all keys are looked up in one ascending array.
        low, span = ms.min() - 1, int(ms.max() - ms.min()) + 2
        if span * (len(starts) + 1) >= 2**62:
            raise ValueError("the candidates of a block lie too far apart")
        placed = of * span + (ms - low)
        release = self._held(own)
        found, active = [], np.arange(len(starts))
        while len(active):
            after = np.searchsorted(placed, active * span + np.clip(release[active] - low, 0, span - 1), side="right")
            inside = after < ends[active]
            active, after = active[inside], after[inside]
            release[active] = ms[after] + self.interval
            found.append(after)
        self._move(own, release, number[part[at] == self.part] if len(self.mixed) else None)
        return np.sort(at[np.concatenate(found)]) if found else np.zeros(0, dtype=np.int64)

    def _begin(self, ms: np.ndarray, part: np.ndarray, block: np.ndarray) -> None:
        begins = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (block[1:] != block[:-1])))
        lows, highs, parts = np.minimum.reduceat(ms, begins), np.maximum.reduceat(ms, begins), part[begins]
        known = self.part is not None and parts[0] == self.part
        before = np.append(self.ms if known else lows[0], highs[:-1])
        same = np.append(known, parts[1:] == parts[:-1])
        if (same & (lows < before)).any():
            raise ValueError("candidates do not come in the order of their blocks")
        if not known:
            self.ids = self.keys = self.release = np.zeros(0, dtype=np.int64)
        self.mixed, self.part, self.ms = np.flatnonzero(parts != parts[-1]), parts[-1], highs[-1]

    def _numbered(self, keys: Sequence[np.ndarray]) -> np.ndarray:
        new = [k[self._at(k) < 0] for k in keys]
        if any(len(n) for n in new):
            ids = np.unique(np.concatenate([*new, self.ids]))
            if len(ids) ** self.width >= 2**62:
                raise ValueError("too many ids in one part")
            held, size = [], len(self.ids)
            rest = self.keys
            for _ in range(self.width):
                held.append(self.ids[rest % size] if size else rest)
                rest = rest // max(size, 1)
            self.ids = ids
            self.keys = self._number(held[::-1])
        return self._number(keys)

    def _at(self, ids: np.ndarray) -> np.ndarray:
        """Places of the ids, -1 of those that are not known."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def _number(self, keys: Sequence[np.ndarray]) -> np.ndarray:
        number = np.zeros(len(keys[0]), dtype=np.int64)
        for k in keys:
            number = number * len(self.ids) + np.searchsorted(self.ids, k)
        return number

    def _held(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(numbers), NEVER)
        at = np.minimum(np.searchsorted(self.keys, numbers), len(self.keys) - 1)
        return np.where(self.keys[at] == numbers, self.release[at], NEVER)

    def _move(self, numbers: np.ndarray, release: np.ndarray, of_part: np.ndarray | None) -> None:
        """``numbers`` leave with these release times; only those of ``of_part`` are kept, if it is given."""
        rest = ~np.isin(self.keys, numbers)
        keys, free = np.append(self.keys[rest], numbers), np.append(self.release[rest], release)
        alive = free >= self.ms
        if of_part is not None:
            alive &= np.isin(keys, of_part)
        keys, free = keys[alive], free[alive]
        at = np.argsort(keys, kind="stable")
        self.keys, self.release = keys[at], free[at]
