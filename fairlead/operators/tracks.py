"""Tracks: runs of fixes of one vessel without a long gap, their statistics, smoothing, filling and thinning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import enrich, sequence
from fairlead.session import stored_table

GAP_MINUTES = 15.0
TRACK_KEYS = ("mmsi", "track_start")
# Points that one task works on at once; results do not depend on it.
SIMPLIFY_BLOCK = 10_000


def with_track(
    positions: DataFrame, gap_minutes: float = GAP_MINUTES, seconds: float = sequence.SLICE_SECONDS
) -> DataFrame:
    """Fixes with the track they belong to.

    Adds ``track_start`` (with the mmsi it names the track), ``row_number`` within the track, ``track_ends`` on
    its last fix, ``prev``, and ``leg_nm``, the distance from the fix before (0 on the first). A gap strictly
    longer than ``gap_minutes`` starts a new track.
    """
    runs = sequence.with_runs(positions, enrich.PREVIOUS_FIELDS, int(gap_minutes * 60_000), seconds=seconds)
    leg = geo.distance_nm(F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude"))
    return runs.withColumnsRenamed({"run_start": "track_start", "run_ends": "track_ends"}).withColumn(
        "leg_nm", F.when(F.col("row_number") > 1, leg).otherwise(F.lit(0.0))
    )


def track_summary(tracked: DataFrame) -> DataFrame:
    """Distance, speeds, ends and number of points per track."""
    return tracked.groupBy(*TRACK_KEYS).agg(
        F.max("ts").alias("track_end"),
        F.count(F.lit(1)).alias("points"),
        F.sum("leg_nm").alias("distance_nm"),
        F.avg("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"),
    )


def smoothed(tracked: DataFrame, each_side: int = 2, block: int = 10_000) -> DataFrame:
    """Moving average of latitude and longitude over the neighbouring fixes of the same track.

    Where the neighbours lie on both sides of the date line, longitudes are averaged in the range 0 to 360.
    """
    rows = sequence.with_surrounding(
        tracked,
        {
            "smooth_latitude": F.avg("latitude"),
            "_plain": F.avg("longitude"),
            "_shifted": F.avg(F.when(F.col("longitude") < 0, F.col("longitude") + 360.0).otherwise(F.col("longitude"))),
            "_east": F.max("longitude"),
            "_west": F.min("longitude"),
        },
        each_side,
        keys=TRACK_KEYS,
        block=block,
    )
    over = F.when(F.col("_shifted") >= 180.0, F.col("_shifted") - 360.0).otherwise(F.col("_shifted"))
    mean = F.when(F.col("_east") - F.col("_west") > 180.0, over).otherwise(F.col("_plain"))
    return rows.withColumn("smooth_longitude", mean).drop("_plain", "_shifted", "_east", "_west")


def gap_filled(
    positions: DataFrame,
    step_seconds: int = 60,
    max_gap_minutes: float = 5.0,
    seconds: float = sequence.SLICE_SECONDS,
) -> DataFrame:
    """Fixes plus linearly interpolated points every step inside gaps shorter than ``max_gap_minutes``."""
    step = int(step_seconds) * 1000
    rows = sequence.with_following(positions, ["latitude", "longitude", "ts"], seconds=seconds)
    gap = F.unix_millis("next.ts") - F.unix_millis("ts")
    steps = F.when(
        (gap > step) & (gap < int(max_gap_minutes * 60_000)),
        F.sequence(F.lit(0), F.expr(f"cast((unix_millis(next.ts) - unix_millis(ts) - 1) div {step} as int)")),
    ).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("step", F.explode(steps))
    share = F.coalesce(F.try_divide((F.col("step") * step).cast("double"), gap.cast("double")), F.lit(0.0))

    ahead = F.col("next.longitude") - F.col("longitude")
    # The short way round: over the date line the difference is taken by 360 degrees less.
    short = F.when(ahead > 180.0, ahead - 360.0).when(ahead < -180.0, ahead + 360.0).otherwise(ahead)

    def between(c: str, way):
        moved = F.col(c) + way * share
        if c == "longitude":
            moved = F.when(moved >= 180.0, moved - 360.0).when(moved < -180.0, moved + 360.0).otherwise(moved)
        return F.when(F.col("step") == 0, F.col(c)).otherwise(moved)

    return spread.select(
        "mmsi",
        "seq",
        "step",
        F.timestamp_millis(F.unix_millis("ts") + F.col("step") * step).alias("ts"),
        between("latitude", F.col("next.latitude") - F.col("latitude")).alias("latitude"),
        between("longitude", short).alias("longitude"),
        (F.col("step") > 0).alias("interpolated"),
    )


def decimated(tracked: DataFrame, every: int = 10) -> DataFrame:
    """Every tenth fix of a track as trail marks, counted from the first; the newest fix is left out."""
    return tracked.where(((F.col("row_number") - 1) % every == 0) & ~F.col("track_ends"))


def keep_within(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on one run of points: mask of the points kept."""
    keep = np.zeros(len(x), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(x) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        square = dx * dx + dy * dy
        along = np.clip((px * dx + py * dy) / square, 0.0, 1.0) if square > 0 else np.zeros(b - a - 1)
        off = np.hypot(px - along * dx, py - along * dy)
        far = int(np.argmax(off))
        if off[far] > tolerance:
            middle = a + 1 + far
            keep[middle] = True
            spans += [(a, middle), (middle, b)]
    return keep


def with_plane(tracked: DataFrame, block: int = SIMPLIFY_BLOCK) -> DataFrame:
    """Add ``x`` and ``y``, nautical miles on one local plane per track, and ``points``, the track's length.

    The plane is true to scale at the mean latitude of the whole track. Longitudes go on over the date line: every
    crossing adds a turn, and the turns are summed by blocks of consecutive points.
    """
    turn = F.when(F.col("row_number") > 1, F.round((F.col("prev.longitude") - F.col("longitude")) / 360.0)).otherwise(0.0)
    rows = tracked.withColumn("_turn", turn).withColumn("_block", F.expr(f"(row_number - 1) div {int(block)}"))
    sums = rows.groupBy(*TRACK_KEYS, "_block").agg(
        F.sum("_turn").alias("_turns"), F.sum("latitude").alias("_lat"), F.count(F.lit(1)).alias("_n")
    )
    track = Window.partitionBy(*TRACK_KEYS)
    before = track.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *TRACK_KEYS,
        "_block",
        F.coalesce(F.sum("_turns").over(before), F.lit(0.0)).alias("_before"),
        (F.sum("_lat").over(track) / F.sum("_n").over(track)).alias("_mean"),
        F.sum("_n").over(track).alias("points"),
    )
    inside = Window.partitionBy(*TRACK_KEYS, "_block").orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    turned = F.col("_before") + F.sum("_turn").over(inside)
    rows = rows.join(sums, [*TRACK_KEYS, "_block"])
    east = (F.col("longitude") + 360.0 * turned) * 60.0 * F.cos(F.radians("_mean"))
    rows = rows.withColumn("x", east).withColumn("y", F.col("latitude") * 60.0)
    return rows.drop("_turn", "_block", "_before", "_mean")


def simplified(tracked: DataFrame, tolerance_nm: float = 0.1, block: int = SIMPLIFY_BLOCK) -> DataFrame:
    """Points of each track that Douglas-Peucker with the tolerance keeps, on the track's own plane.

    Tracks of at most ``block`` points are simplified in one pass each, the others by :func:`_split_up`; the result is the
    same whatever the block.
    """
    step = max(3, int(block))
    names = ("row_number", "seq", "ts", "latitude", "longitude")
    rows = stored_table(tracked.select(*TRACK_KEYS, *names, F.struct("prev.longitude").alias("prev")), "track-points")
    large = rows.groupBy(*TRACK_KEYS).agg(F.max("row_number").alias("points")).where(F.col("points") > step).select(*TRACK_KEYS)
    if not large.limit(1).count():
        return _whole(rows, tolerance_nm).select(*TRACK_KEYS, *names)
    large = stored_table(large, "large-tracks")
    small = _whole(rows.join(large, list(TRACK_KEYS), "left_anti"), tolerance_nm)
    split = _split_up(rows.join(large, list(TRACK_KEYS), "left_semi"), tolerance_nm, step)
    return small.select(*TRACK_KEYS, *names).unionByName(split.select(*TRACK_KEYS, *names))


def _whole(rows: DataFrame, tolerance_nm: float) -> DataFrame:
    """The points that are kept of tracks that fit one row; the plane is that of :func:`with_plane`."""

    @F.pandas_udf("array<int>")
    def kept(lats: pd.Series, lons: pd.Series, turns: pd.Series) -> pd.Series:
        found = []
        for lat, lon, turn in zip(lats, lons, turns):
            lat, lon = np.asarray(lat, dtype=float), np.asarray(lon, dtype=float)
            east = (lon + 360.0 * np.cumsum(np.asarray(turn, dtype=float))) * 60.0 * np.cos(np.radians(lat.mean()))
            found.append(np.flatnonzero(keep_within(east, lat * 60.0, tolerance_nm)).astype("int32"))
        return pd.Series(found)

    turn = F.when(F.col("row_number") > 1, F.round((F.col("prev.longitude") - F.col("longitude")) / 360.0)).otherwise(0.0)
    point = F.struct("row_number", "seq", "ts", "latitude", "longitude", turn.alias("turn"))
    lists = rows.groupBy(*TRACK_KEYS).agg(F.sort_array(F.collect_list(point)).alias("points"))
    picked = F.transform(kept(F.col("points.latitude"), F.col("points.longitude"), F.col("points.turn")), lambda at: F.get("points", at))
    return lists.select(*TRACK_KEYS, F.explode(picked).alias("p")).select(*TRACK_KEYS, "p.*")


def _split_up(tracked: DataFrame, tolerance_nm: float, step: int) -> DataFrame:
    """:func:`simplified` for tracks of any length.

    Both halves of a split go on independently of each other. So spans of more than ``step`` points are split by
    distributed aggregation, one level at a time for all of them, and shorter spans are finished in one task each.
    """
    fields = F.struct("row_number", "seq", "ts", "latitude", "longitude", "x", "y")
    rows = with_plane(tracked, step).select(*TRACK_KEYS, "points", fields.alias("p"))
    rows = stored_table(rows, "track-plane")
    ends = rows.where((F.col("p.row_number") == 1) | (F.col("p.row_number") == F.col("points"))).select(*TRACK_KEYS, "p")
    span = rows.groupBy(*TRACK_KEYS).agg(F.min_by("p", "p.row_number").alias("a"), F.max_by("p", "p.row_number").alias("b"))
    inner = rows.join(span, list(TRACK_KEYS)).where(_inside("a", "b")).select(*TRACK_KEYS, "a", "b", "p")
    kept = [ends]
    size = F.col("b.row_number") - F.col("a.row_number") + 1
    finish = [inner.where(size <= step)]
    large = stored_table(inner.where(size > step), "track-spans")
    while large.limit(1).count():
        # Ties go to the earlier point, as in the local pass.
        farthest = F.max(F.struct(_off_span().alias("off"), (-F.col("p.row_number")).alias("first"), F.col("p").alias("m")))
        split = large.groupBy(*TRACK_KEYS, "a", "b").agg(farthest.alias("far")).where(F.col("far.off") > tolerance_nm)
        split = stored_table(split.select(*TRACK_KEYS, "a", "b", "far.m"), "track-splits")
        kept.append(split.select(*TRACK_KEYS, F.col("m").alias("p")))
        parts = large.join(split, [*TRACK_KEYS, "a", "b"]).where(F.col("p.row_number") != F.col("m.row_number"))
        left = F.col("p.row_number") < F.col("m.row_number")
        parts = parts.select(
            *TRACK_KEYS, F.when(left, F.col("a")).otherwise(F.col("m")).alias("a"),
            F.when(left, F.col("m")).otherwise(F.col("b")).alias("b"), "p",
        )
        parts = stored_table(parts, "track-spans")
        finish.append(parts.where(size <= step))
        large = parts.where(size > step)
    for spans in finish:
        kept.append(_finished(spans, tolerance_nm))
    done = kept[0]
    for more in kept[1:]:
        done = done.unionByName(more)
    return done.select(*TRACK_KEYS, "p.row_number", "p.seq", "p.ts", "p.latitude", "p.longitude")


def _inside(a: str, b: str):
    return (F.col("p.row_number") > F.col(f"{a}.row_number")) & (F.col("p.row_number") < F.col(f"{b}.row_number"))


def _off_span():
    """Distance of a point from the line between the ends of its span."""
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    px, py = F.col("p.x") - F.col("a.x"), F.col("p.y") - F.col("a.y")
    square = dx * dx + dy * dy
    along = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / square))).otherwise(0.0)
    return F.hypot(px - along * dx, py - along * dy)


def _finished(spans: DataFrame, tolerance_nm: float) -> DataFrame:
    """The inner points that a local pass keeps; a span and its ends fit one row by the size of a block."""

    @F.pandas_udf("array<int>")
    def inner(xs: pd.Series, ys: pd.Series) -> pd.Series:
        masks = [keep_within(np.asarray(x), np.asarray(y), tolerance_nm) for x, y in zip(xs, ys)]
        return pd.Series([np.flatnonzero(m[1:-1]).astype("int32") for m in masks])

    lists = spans.groupBy(*TRACK_KEYS, "a", "b").agg(F.sort_array(F.collect_list("p")).alias("points"))
    line = lambda c: F.concat(F.array(f"a.{c}"), f"points.{c}", F.array(f"b.{c}"))
    picked = F.transform(inner(line("x"), line("y")), lambda at: F.get("points", at))
    return lists.select(*TRACK_KEYS, F.explode(picked).alias("p"))


def track_lines(tracked: DataFrame, block: int | None = None) -> DataFrame:
    """GeoJSON LineString features, one per track.

    ``block`` asks for pieces of that many points instead, which share a point with the piece before.
    """
    bridge = F.when(F.col("row_number") > 1, F.array(F.col("prev.longitude"), F.col("prev.latitude")))
    piece = F.expr(f"(row_number - 1) div {int(block)}") if block else F.lit(0).cast("long")
    pieces = (
        tracked.withColumn("piece", piece)
        .groupBy(*TRACK_KEYS, "piece")
        .agg(
            F.sort_array(F.collect_list(F.struct("row_number", F.array("longitude", "latitude").alias("p")))).alias("_points"),
            F.min_by(bridge, F.col("row_number")).alias("_bridge"),
        )
    )
    coordinates = F.concat(
        F.when(F.col("_bridge").isNotNull(), F.array("_bridge")).otherwise(F.array().cast("array<array<double>>")),
        F.col("_points.p"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct("mmsi", F.unix_millis("track_start").alias("track_start")).alias("properties"),
    )
    return pieces.select(
        *TRACK_KEYS, "piece", F.size(coordinates).alias("points"), F.to_json(feature).alias("feature"),
    )


