"""Fence membership and events, radius and box search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions import alerting, geo
from fairlead.operators import sequence, skew

# Cell sizes in degrees, each a whole part of the circle; a fence uses the finest that covers it in few cells.
CELL_SIZES = (0.25, 1.0, 5.0, 20.0, 90.0)
CELLS_ACROSS = 16
FENCE_ROWS = 20_000
FENCE_EDGES = 500_000
KM_PER_DEGREE = 111.0


def _cell(degrees: Column, size: float) -> Column:
    """Number of a cell around the circle; the last one meets the first at the date line."""
    return F.pmod(F.floor(degrees / size), F.lit(round(360.0 / size))).cast("int")


def _unwrapped(rings: Column) -> Column:
    """Rings whose longitudes go on over the date line: an edge takes the shorter way round."""

    def onward(held: Column, p: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))["lon"]
        turns = F.coalesce(F.round((last - p["lon"]) / 360.0), F.lit(0.0))
        moved = F.struct(*[(p["lon"] + 360.0 * turns if n == "lon" else p["lat"]).alias(n) for n in ("lon", "lat")])
        return F.concat(held, F.array(moved))

    point = "array<struct<lon:double,lat:double>>"

    def whole(ring: Column) -> Column:
        plain = F.transform(ring, lambda p: F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat")))
        wide = F.array_max(ring["lon"]) - F.array_min(ring["lon"]) > 180.0
        return F.when(wide, F.aggregate(plain, F.array().cast(point), onward)).otherwise(plain)

    return F.transform(rings, whole)


def fence_rows(fences: DataFrame) -> DataFrame:
    """One row per active fence and cell that its bounding box touches: (size, _cx, _cy, fence).

    The size follows the fence, so a fence takes at most (CELLS_ACROSS + 1) squared rows, an ocean included. Where
    ``fences`` has ``valid_from`` and ``valid_to``, a row is one version of a fence and holds fixes of that time only.
    """
    span = [c for c in ("valid_from", "valid_to") if c in fences.columns]
    unwrapped = fences.where("is_active").select("id", _unwrapped(F.col("rings")).alias("rings"), *span)
    outline = F.flatten("rings")
    west, east = F.array_min(outline["lon"]), F.array_max(outline["lon"])
    south, north = F.array_min(outline["lat"]), F.array_max(outline["lat"])
    boxed = unwrapped.select(
        F.struct(
            "id",
            west.alias("west"),
            east.alias("east"),
            south.alias("south"),
            north.alias("north"),
            geo.ring_edges(F.col("rings")).alias("edges"),
            *span,
        ).alias("fence"),
        F.greatest(east - west, north - south).alias("_extent"),
    )
    size = F.coalesce(*[F.when(F.col("_extent") <= s * CELLS_ACROSS, F.lit(s)) for s in CELL_SIZES], F.lit(CELL_SIZES[-1]))
    sized = boxed.where("_extent IS NOT NULL").withColumn("size", size)

    def cells(low: str, high: str) -> Column:
        span = F.sequence(F.floor(F.col(f"fence.{low}") / F.col("size")), F.floor(F.col(f"fence.{high}") / F.col("size")))
        return F.transform(span, lambda c: F.pmod(c, F.round(360.0 / F.col("size")).cast("long")).cast("int"))

    spread = sized.withColumn("_cx", F.explode(F.array_distinct(cells("west", "east"))))
    return spread.withColumn("_cy", F.explode(F.array_distinct(cells("south", "north")))).drop("_extent")


def holds(fence: Column, versions: bool = False) -> Column:
    """Whether a fence struct holds the position of the row; the bounding box is looked at first.

    With ``versions`` the fence must also be valid at the time of the row.
    """
    lat = F.col("latitude")
    lon = F.when(F.col("longitude") < fence["west"], F.col("longitude") + 360.0).otherwise(F.col("longitude"))
    boxed = lat.between(fence["south"], fence["north"]) & lon.between(fence["west"], fence["east"])
    if versions:
        ts = F.col("ts")
        boxed &= F.coalesce(ts >= fence["valid_from"], F.lit(True)) & F.coalesce(ts < fence["valid_to"], F.lit(True))
    return F.when(boxed, geo.inside_edges(lat, lon, fence["edges"])).otherwise(F.lit(False))


def fence_versions(log: DataFrame) -> DataFrame:
    """Every row of a fence log (id, changed_at and the fence as it is from then on) with the time it is valid for.

    Of changes of a fence at one time the row that is last in the order of all its texts counts; the others hold nothing.
    """
    following = Window.partitionBy("id").orderBy(F.asc_nulls_first("changed_at"), F.to_json(F.struct(*[c for c in log.columns if c != "id"])))
    return log.withColumns({"valid_from": F.col("changed_at"), "valid_to": F.lead("changed_at").over(following)})


def fences_are_small(rows: DataFrame, max_rows: int = FENCE_ROWS, max_edges: int = FENCE_EDGES) -> bool:
    """Whether the fences of all cells fit on every executor, by their rows and by the edges that these carry."""
    looked = rows.select(F.size("fence.edges").alias("n")).limit(max_rows + 1)
    found = looked.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges")).first()
    return found["rows"] <= max_rows and found["edges"] <= max_edges


def with_fences_inside(
    positions: DataFrame, fences: DataFrame, max_rows: int = FENCE_ROWS, max_edges: int = FENCE_EDGES
) -> DataFrame:
    """``inside`` = sorted ids of the active fences that hold the position.

    Positions meet only the fences of their cells, one cell for each size in use. While the fences are small enough,
    those of a cell travel as one array and positions stay one row each. Beyond that, positions and fences are joined
    row by row, with busy cells salted, and the ids are put together per position. A stream needs the first way.
    """
    rows, none, versions = fence_rows(fences), F.array().cast("array<int>"), "valid_from" in fences.columns
    cell, spread = ["_cx", "_cy"], [F.col("mmsi"), F.col("seq")]
    sizes = [r["size"] for r in rows.select("size").distinct().orderBy("size").collect()]
    if not sizes:
        return positions.withColumn("inside", none)

    def placed(frame: DataFrame, size: float) -> DataFrame:
        return frame.withColumns({"_cx": _cell(F.col("longitude"), size), "_cy": _cell(F.col("latitude"), size)})

    if positions.isStreaming or fences_are_small(rows, max_rows, max_edges):
        located, found = positions, []
        for i, size in enumerate(sizes):
            lists = rows.where(F.col("size") == size).groupBy(*cell).agg(F.collect_list("fence").alias(f"_fences{i}"))
            located = skew.join_dimension(placed(located, size), lists, cell, spread).drop(*cell)
            ids = F.transform(F.filter(f"_fences{i}", lambda f: holds(f, versions)), lambda f: f["id"])
            located = located.withColumn(f"_inside{i}", F.coalesce(ids, none)).drop(f"_fences{i}")
            found.append(f"_inside{i}")
        return located.withColumn("inside", F.array_sort(F.concat(*found))).drop(*found)
    hits = None
    for size in sizes:
        own = rows.where(F.col("size") == size).drop("size")
        narrow = placed(positions.select("mmsi", "seq", "latitude", "longitude", *(["ts"] if versions else [])), size)
        met = skew.salted_join(narrow, own, cell, spread, "inner").where(holds(F.col("fence"), versions)).select("mmsi", "seq", "fence.id")
        hits = met if hits is None else hits.unionByName(met)
    ids = hits.groupBy("mmsi", "seq").agg(F.array_sort(F.collect_set("id")).alias("inside"))
    return positions.join(ids, ["mmsi", "seq"], "left").withColumn("inside", F.coalesce("inside", none)).select(
        *positions.columns, "inside"
    )


def fence_membership(positions: DataFrame, fences: DataFrame) -> DataFrame:
    """Latest position of each vessel with every active fence that holds it."""
    latest = sequence.latest_per_key(positions, ["mmsi"])
    hits = with_fences_inside(latest, fences).withColumn("id", F.explode("inside")).drop("inside")
    names = fences.select("id", "name", "geofence_type", "alert_on_entry")
    return skew.join_dimension(hits, names, ["id"], spread=[F.col("mmsi")], how="inner").withColumnRenamed(
        "id", "fence_id"
    )


def fence_events(
    positions: DataFrame, fences: DataFrame, seconds: float = sequence.SLICE_SECONDS
) -> DataFrame:
    """ENTRY / EXIT whenever the set of fences around a vessel changes; one state per (vessel, fence)."""
    rows = sequence.with_previous(with_fences_inside(positions, fences), ["inside"], seconds=seconds)
    before = F.coalesce("prev.inside", F.array().cast("array<int>"))

    def events(ids: Column, kind: str) -> Column:
        return F.transform(ids, lambda i: F.struct(i.alias("fence_id"), F.lit(kind).alias("event")))

    changes = F.concat(
        events(F.array_except("inside", before), "ENTRY"), events(F.array_except(before, F.col("inside")), "EXIT")
    )
    return rows.select(
        "mmsi", "vessel_name", "latitude", "longitude", "speed", "ts", "seq", F.explode(changes).alias("_e")
    ).select("*", "_e.*").drop("_e")


def fence_alerts(events: DataFrame, fences: DataFrame) -> DataFrame:
    """Alert rows of fence events, honouring the entry and exit switches of the fence."""
    attributes = fences.select(
        F.col("id").alias("fence_id"), F.col("name").alias("fence_name"), "geofence_type", "alert_on_entry",
        "alert_on_exit",
    )
    joined = skew.join_dimension(events, attributes, ["fence_id"], spread=[F.col("mmsi"), F.col("seq")], how="inner")
    entry = F.col("event") == "ENTRY"
    wanted = joined.where(F.when(entry, F.col("alert_on_entry")).otherwise(F.col("alert_on_exit")))
    restricted = entry & (F.col("geofence_type") == "RESTRICTED")
    kind = (
        F.when(restricted, "RESTRICTED_AREA_ENTRY").when(entry, "GEOFENCE_ENTRY").otherwise("GEOFENCE_EXIT")
    )
    return wanted.select(
        *alerting.alert_row(
            alert_type=kind,
            severity=F.when(restricted, "CRITICAL").otherwise("INFO"),
            mmsi=F.col("mmsi"),
            vessel_name=F.col("vessel_name"),
            latitude=F.col("latitude"),
            longitude=F.col("longitude"),
            speed=F.col("speed"),
            ts=F.col("ts"),
            seq=F.col("seq"),
            title=F.when(restricted, "Restricted Area Entered").when(entry, "Geofence Entered").otherwise(
                "Geofence Left"
            ),
            description=F.format_string(
                "Vessel %s %s %s",
                F.coalesce("vessel_name", F.lit("null")),
                F.when(entry, "entered").otherwise("left"),
                F.col("fence_name"),
            ),
            details=alerting.details_map(fence_id=F.col("fence_id"), fence_type=F.col("geofence_type")),
            action_required=restricted,
            identity=(F.col("fence_id"),),
        )
    )


def nearest_port(rows: DataFrame, ports: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Add ``port_id`` and ``distance_km`` of the nearest port of a fixed list (id, latitude, longitude).

    The list is part of the plan, so there is no join; ties go to the smaller id.
    """
    away = [
        F.struct(geo.distance_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)).alias("distance_km"), F.lit(name).alias("port_id"))
        for name, lat, lon in ports
    ]
    return rows.withColumn("_near", F.array_min(F.array(*away))).select("*", "_near.port_id", "_near.distance_km").drop("_near")


def reach_degrees(lat: float, km: float) -> tuple[float, float]:
    """Half height and half width in degrees of a box that holds the circle around a point."""
    import math

    angle = km / geo.EARTH_RADIUS_KM
    # A hair wider than the circle, so that rounding never cuts a point on its rim.
    slack = 1 + 1e-9
    if math.cos(math.radians(lat)) <= math.sin(angle) or angle >= math.pi / 2:
        return math.degrees(angle) * slack, 360.0
    return (
        math.degrees(angle) * slack,
        math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(lat)))) * slack,
    )


def within_radius(rows: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows at most ``km`` from a point, with ``distance_km``; a box on plain columns prunes the scan first."""
    high, wide = reach_degrees(lat, km)
    boxed = rows.where(F.col("latitude").between(lat - high, lat + high))
    if wide < 180 and -180 <= lon - wide and lon + wide <= 180:
        boxed = boxed.where(F.col("longitude").between(lon - wide, lon + wide))
    elif wide < 180:
        # The box crosses the date line: two intervals.
        west, east = (lon - wide + 180) % 360 - 180, (lon + wide + 180) % 360 - 180
        boxed = boxed.where((F.col("longitude") >= west) | (F.col("longitude") <= east))
    away = geo.distance_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    return boxed.withColumn("distance_km", away).where(F.col("distance_km") <= km)


def nearest(rows: DataFrame, lat: float, lon: float, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows; a top-k per task, merged at the end."""
    away = geo.distance_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    return rows.withColumn("distance_km", away).orderBy("distance_km", "mmsi").limit(k)


def in_view(
    positions: DataFrame, south: float, west: float, north: float, east: float, since: Column
) -> DataFrame:
    """Latest fix of each vessel, where it is recent and inside the viewport."""
    recent = positions.where(F.col("ts") > since)
    latest = sequence.latest_per_key(recent, ["mmsi"])
    return latest.where(geo.in_box(F.col("latitude"), F.col("longitude"), south, west, north, east))


def weather_near(weather: DataFrame, lat: float, lon: float, km: float = 50.0, n: int = 10) -> DataFrame:
    """Newest, then nearest ``n`` readings within the radius."""
    near = within_radius(weather, lat, lon, km)
    return near.orderBy(F.desc("ts"), "distance_km", "seq").limit(n)


def weather_for_view(
    weather: DataFrame, south: float, west: float, north: float, east: float, cap_km: float = 500.0
) -> DataFrame:
    """Weather around the middle of a viewport; the radius follows from its larger side, up to a cap."""
    km = max(abs(north - south), abs(east - west)) * KM_PER_DEGREE / 2
    return weather_near(weather, (north + south) / 2, (east + west) / 2, min(km, cap_km))
