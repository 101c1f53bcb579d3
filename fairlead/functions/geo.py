"""Geometry on latitude / longitude columns. Everything is a Column expression, nothing leaves the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii used for distances and destinations.
EARTH_RADIUS_NM = 3440.065
EARTH_RADIUS_KM = 6371.0088
DESTINATION_RADIUS_KM = 6371.0


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    """Haversine distance in the unit of ``radius``."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(chord), F.sqrt(F.greatest(F.lit(0.0), 1.0 - chord)))


def great_circle_of(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, radius: float) -> np.ndarray:
    """:func:`great_circle` for arrays, where a step in Python needs it; NaN where a coordinate is missing."""
    half_lat, half_lon = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half_lon * half_lon
    return 2.0 * radius * np.arctan2(np.sqrt(chord), np.sqrt(np.maximum(0.0, 1.0 - chord)))


def distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return great_circle(lat1, lon1, lat2, lon2, EARTH_RADIUS_NM)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return great_circle(lat1, lon1, lat2, lon2, EARTH_RADIUS_KM)


def position_cell(lat: Column, lon: Column) -> Column:
    """Tenth-degree cell label, cut toward zero; ``UNKNOWN`` without coordinates."""
    label = F.concat_ws("_", (lat * 10).cast("int").cast("string"), (lon * 10).cast("int").cast("string"))
    return F.when(lat.isNull() | lon.isNull(), F.lit("UNKNOWN")).otherwise(label)


def weather_cell(lat: Column, lon: Column) -> Column:
    """Tenth-degree cell label, rounded half up (toward plus infinity); missing coordinates count as 0."""

    def tenth(x: Column) -> Column:
        return F.floor(F.coalesce(x, F.lit(0.0)) * 10 + 0.5).cast("string")

    return F.concat_ws("_", tenth(lat), tenth(lon))


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar bearing in degrees [0, 360) from the first to the second point."""
    return F.pmod(F.degrees(F.atan2(lon2 - lon1, lat2 - lat1)) + 360.0, F.lit(360.0))


def planar_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance in degrees."""
    return F.sqrt((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle between two directions, in degrees [0, 180]."""
    turn = F.pmod(a - b, F.lit(360.0))
    return F.least(turn, 360.0 - turn)


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> Column:
    """Struct(lat, lon) reached from a point after ``km`` on the given bearing."""
    arc = km / DESTINATION_RADIUS_KM
    heading = F.radians(bearing)
    phi = F.radians(lat)
    phi2 = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(heading))
    east = F.sin(heading) * F.sin(arc) * F.cos(phi)
    north = F.cos(arc) - F.sin(phi) * F.sin(phi2)
    return F.struct(
        F.degrees(phi2).alias("lat"),
        F.degrees(F.radians(lon) + F.atan2(east, north)).alias("lon"),
    )


def compass_octant(course: Column) -> Column:
    """N, NE, ... for a course in degrees."""
    # The eight names, clockwise from north.
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    slot = F.pmod(F.floor(course / 45 + 0.5), F.lit(8)).cast("int")
    return F.when(course.isNotNull(), F.get(names, slot))


def in_box(lat: Column, lon: Column, south, west, north, east) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def ring_edges(rings: Column) -> Column:
    """All edges of a list of rings as array<struct<x1, y1, x2, y2>>; each ring closes on its first point."""

    def edges(ring: Column) -> Column:
        return F.transform(
            ring,
            lambda p, i: F.struct(
                p["lon"].alias("x1"),
                p["lat"].alias("y1"),
                F.get(ring, F.pmod(i + 1, F.size(ring)))["lon"].alias("x2"),
                F.get(ring, F.pmod(i + 1, F.size(ring)))["lat"].alias("y2"),
            ),
        )

    return F.flatten(F.transform(rings, edges))


def inside_edges(lat: Column, lon: Column, edges: Column) -> Column:
    """Even-odd ray cast; holes are simply further rings."""

    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        at = (e["x2"] - e["x1"]) * F.try_divide(lat - e["y1"], e["y2"] - e["y1"]) + e["x1"]
        return straddles & F.coalesce(lon < at, F.lit(False))

    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != crosses(e))
