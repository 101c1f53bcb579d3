"""Per-vessel sequence operators that do not need all rows of a vessel in one task.

Rows are grouped by (key, time slice). A window inside the slice does the row-level work; what has to cross a
slice border is reduced to one row per slice first, carried over in a small window, and joined back on the
same (key, slice) hash partitioning. One exchange of the wide rows, whatever the number of operators chained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
SLICE_SECONDS = 3600
ROWS_PER_SLICE = 500_000


def slice_seconds(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("mmsi",),
    ts: str = "ts",
    rows: int = ROWS_PER_SLICE,
    longest: float = SLICE_SECONDS,
) -> float:
    """Slice length at which the busiest key has at most about ``rows`` rows in a slice.

    One pass over the key and time columns, aggregated before the shuffle; a single number comes back.
    """
    per_minute = df.groupBy(*keys, F.date_trunc("minute", ts).alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
    busiest = per_minute.agg(F.max("_n")).first()[0] or 1
    return max(0.001, min(float(longest), rows * 60.0 / busiest))


def with_slice(df: DataFrame, seconds: float = SLICE_SECONDS, ts: str = "ts") -> DataFrame:
    """Add the time slice; an existing one is kept so that chained operators share a partitioning."""
    if SLICE in df.columns:
        return df
    return df.withColumn(SLICE, F.expr(f"unix_millis({ts}) div {max(1, int(seconds * 1000))}"))


def _inside(keys: Sequence[str], ts: str, seq: str):
    return Window.partitionBy(*keys, SLICE).orderBy(ts, seq)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE)


def with_context(
    df: DataFrame,
    *,
    previous: dict[str, Sequence[str]] | None = None,
    following: dict[str, Sequence[str]] | None = None,
    number: str | None = None,
    keys: Sequence[str] = ("mmsi",),
    ts: str = "ts",
    seq: str = "seq",
    seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """Neighbours and running numbers in one go.

    ``previous`` and ``following`` map an output name to the fields of the neighbouring row that its struct
    holds (NULL at the ends); ``number`` names a running number from 1. All of them share one summary per slice
    and one join.
    """
    keys, place = list(keys), F.struct(ts, seq)
    rows = with_slice(df, seconds, ts)
    inside, across = _inside(keys, ts, seq), _across(keys)
    windowed, summary, carried, merged = {}, [], [], {}
    for names, shift, pick in ((previous or {}, F.lag, F.max_by), (following or {}, F.lead, F.min_by)):
        for out, fields in names.items():
            windowed[out] = shift(F.struct(*fields)).over(inside)
            summary.append(pick(F.struct(*fields), place).alias(f"_c_{out}"))
            carried.append(shift(f"_c_{out}").over(across).alias(f"_c_{out}"))
            merged[out] = F.coalesce(out, f"_c_{out}")
    if number:
        windowed[number] = F.row_number().over(inside).cast("bigint")
        summary.append(F.count(F.lit(1)).alias(f"_c_{number}"))
        before = F.sum(f"_c_{number}").over(across.rowsBetween(Window.unboundedPreceding, -1))
        carried.append(before.alias(f"_c_{number}"))
        merged[number] = F.col(number) + F.coalesce(f"_c_{number}", F.lit(0))
    slices = rows.groupBy(*keys, SLICE).agg(*summary).select(*keys, SLICE, *carried)
    joined = rows.withColumns(windowed).join(slices, [*keys, SLICE], "left")
    return joined.withColumns(merged).drop(*[f"_c_{out}" for out in merged])


def with_previous(df: DataFrame, fields: Sequence[str], out: str = "prev", **options) -> DataFrame:
    """``out`` = struct of ``fields`` of the preceding row of the key, NULL on the first row."""
    return with_context(df, previous={out: fields}, **options)


def with_following(df: DataFrame, fields: Sequence[str], out: str = "next", **options) -> DataFrame:
    """``out`` = struct of ``fields`` of the succeeding row of the key, NULL on the last row."""
    return with_context(df, following={out: fields}, **options)


def with_row_number(df: DataFrame, out: str = "row_number", **options) -> DataFrame:
    """1, 2, 3, ... in time order per key."""
    return with_context(df, number=out, **options)


def with_runs(
    df: DataFrame,
    fields: Sequence[str],
    gap_ms: int,
    *,
    keys: Sequence[str] = ("mmsi",),
    ts: str = "ts",
    seq: str = "seq",
    seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """Runs of rows of a key without a gap longer than ``gap_ms``.

    Adds ``prev`` (struct of ``fields`` and the time, of the preceding row of the key), ``run_start`` (time of
    the first row of the run), ``row_number`` within the run, and ``run_ends`` on its last row. Each slice
    reports its first and last row, its size, and where its last own run starts; one window over these gives
    every slice the run it continues.
    """
    keys, place = list(keys), F.struct(ts, seq)
    inside, across = _inside(keys, ts, seq), _across(keys)
    upto, before = (
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        across.rowsBetween(Window.unboundedPreceding, -1),
    )

    def far(later: Column, earlier: Column) -> Column:
        return F.unix_millis(later) - F.unix_millis(earlier) > gap_ms

    payload = F.struct(*[f for f in fields if f != ts], ts)
    rows = with_slice(df, seconds, ts).withColumns(
        {
            "prev": F.lag(payload).over(inside),
            "_next": F.lead(ts).over(inside),
            "_n": F.row_number().over(inside).cast("bigint"),
        }
    )
    own_start = F.when(far(F.col(ts), F.col(f"prev.{ts}")), F.struct(F.col(ts).alias("at"), F.col("_n").alias("n")))
    rows = rows.withColumn("_own", F.last(own_start, ignorenulls=True).over(upto))
    slices = (
        rows.groupBy(*keys, SLICE)
        .agg(
            F.min(ts).alias("_first"),
            F.max_by(payload, place).alias("_last"),
            F.max_by("_own", place).alias("_end"),
            F.count(F.lit(1)).alias("_size"),
        )
        .withColumns(
            {
                "_before": F.lag("_last").over(across),
                "_after": F.lead("_first").over(across),
                "_offset": F.coalesce(F.sum("_size").over(before), F.lit(0)),
            }
        )
        .withColumn("_opens", F.col("_before").isNull() | far(F.col("_first"), F.col(f"_before.{ts}")))
    )
    opened = F.struct(F.col("_first").alias("at"), F.col("_offset").alias("index"))
    left_open = F.when(
        F.col("_end").isNotNull(),
        F.struct(F.col("_end.at").alias("at"), (F.col("_offset") + F.col("_end.n") - 1).alias("index")),
    ).when(F.col("_opens"), opened)
    slices = slices.withColumn("_run", F.when(F.col("_opens"), opened).otherwise(
        F.last(left_open, ignorenulls=True).over(before)
    )).select(*keys, SLICE, "_before", "_after", "_offset", "_run")
    joined = rows.join(slices, [*keys, SLICE], "left")
    own = F.struct(F.col("_own.at").alias("at"), (F.col("_offset") + F.col("_own.n") - 1).alias("index"))
    joined = joined.withColumn("_run", F.when(F.col("_own").isNotNull(), own).otherwise(F.col("_run")))
    follower = F.coalesce("_next", "_after")
    return joined.withColumns(
        {
            "prev": F.coalesce("prev", "_before"),
            "run_start": F.col("_run.at"),
            "row_number": F.col("_offset") + F.col("_n") - F.col("_run.index"),
            "run_ends": follower.isNull() | far(follower, F.col(ts)),
        }
    ).drop("_next", "_n", "_own", "_before", "_after", "_offset", "_run")


# How partial results of the same aggregate are put together.
MERGE = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
PARTIAL = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def trailing(
    df: DataFrame,
    aggregates: dict[str, tuple[str, str]],
    lookback_seconds: int,
    *,
    keys: Sequence[str] = ("mmsi",),
    ts: str = "ts",
    seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Aggregates over the last ``lookback_seconds`` (whole seconds, both ends included), per key and second.

    ``aggregates`` maps a name to (min | max | sum | count, column). Rows are first combined per second, map-side,
    so that the window sees at most one row per second of a key. Each slice also gets the seconds that lie within
    the lookback before its start; ``seconds`` must be at least the lookback.
    """
    if seconds < lookback_seconds:
        raise ValueError("a slice must be at least as long as the lookback")
    per_second = df.groupBy(*keys, F.unix_seconds(ts).alias("second")).agg(
        *[PARTIAL[kind](column).alias(name) for name, (kind, column) in aggregates.items()]
    )
    home = F.expr(f"second div {int(seconds)}")
    reach = F.expr(f"(second + {int(lookback_seconds)}) div {int(seconds)}")
    rows = per_second.withColumn("_home", home).withColumn(SLICE, F.explode(F.sequence(home, reach)))
    frame = (
        Window.partitionBy(*keys, SLICE)
        .orderBy("second")
        .rangeBetween(-lookback_seconds, Window.currentRow)
    )
    ranked = rows.withColumns({name: MERGE[kind](name).over(frame) for name, (kind, _) in aggregates.items()})
    return ranked.where(F.col(SLICE) == F.col("_home")).drop("_home", SLICE)


def with_trailing(
    df: DataFrame, aggregates: dict[str, tuple[str, str]], lookback_seconds: int, *, ts: str = "ts",
    keys: Sequence[str] = ("mmsi",), keep: Column | None = None, **options,
) -> DataFrame:
    """The rows with their trailing aggregates; ``keep`` is a condition on these, applied before the join back."""
    results = trailing(df, aggregates, lookback_seconds, keys=keys, ts=ts, **options)
    if keep is not None:
        results = results.where(keep)
    return df.withColumn("second", F.unix_seconds(ts)).join(results, [*keys, "second"]).drop("second")


def with_surrounding(
    df: DataFrame,
    aggregates: dict[str, Column],
    rows_each_side: int,
    *,
    keys: Sequence[str],
    number: str = "row_number",
    block: int = 10_000,
) -> DataFrame:
    """Aggregates over the ``k`` rows before to the ``k`` rows after, by row number within the key.

    Blocks of consecutive row numbers are worked on separately; each also gets the ``k`` rows on both sides.
    """
    k = rows_each_side
    if block < 2 * k:
        raise ValueError("a block must hold at least twice the rows on each side")
    first, last = (F.expr(f"({number} - 1 + {shift}) div {block}") for shift in (-k, k))
    rows = (
        df.withColumn("_home", F.expr(f"({number} - 1) div {block}"))
        .withColumn("_block", F.explode(F.sequence(F.greatest(F.lit(0), first), last)))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy(number).rowsBetween(-k, k)
    ranked = rows.withColumns({name: agg.over(frame) for name, agg in aggregates.items()})
    return ranked.where(F.col("_block") == F.col("_home")).drop("_home", "_block")


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest row of each key; combined map-side, so a hot key sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, seq)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def newest_n_per_key(
    df: DataFrame, n: int, keys: Sequence[str], ts: str = "ts", seq: str = "seq", rank: str = "rank"
) -> DataFrame:
    """The ``n`` newest rows of each key; Spark cuts each map task to ``n`` rows per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(seq))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)
