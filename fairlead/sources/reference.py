"""Fixed reference lists: subscription boxes, weather points, ports, fences, alert rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Box(NamedTuple):
    name: str
    west: float
    south: float
    east: float
    north: float


# The named subscription boxes.
BOXES = (
    Box("Jakarta-Tanjung-Priok", 106.7, -6.2, 107.0, -6.0),
    Box("Surabaya-Tanjung-Perak", 112.6, -7.3, 112.9, -7.1),
    Box("Makassar-Port", 119.3, -5.2, 119.5, -5.0),
    Box("Batam-Singapore-Strait", 103.9, 1.0, 104.2, 1.3),
    Box("Belawan-Medan", 98.6, 3.5, 98.8, 3.7),
    Box("Benoa-Bali", 115.1, -8.8, 115.3, -8.7),
    Box("Padang-Port", 100.3, -1.0, 100.5, -0.9),
)

# Weather monitoring points as (latitude, longitude).
WEATHER_POINTS = (
    (-6.11, 106.89),
    (-7.21, 112.74),
    (-5.13, 119.43),
    (1.15, 104.03),
    (3.59, 98.67),
    (-8.75, 115.17),
    (-0.95, 100.35),
    (-5.85, 110.50),
    (-6.25, 108.50),
    (-6.50, 111.00),
    (-5.50, 112.50),
    (-2.50, 118.00),
    (-3.50, 118.50),
    (-4.50, 118.80),
    (2.50, 100.50),
    (1.80, 101.50),
    (0.90, 102.80),
    (-6.05, 105.45),
    (-8.45, 115.65),
    (-4.50, 128.00),
    (-6.00, 130.50),
    (1.50, 121.00),
    (2.50, 123.50),
    (-1.27, 116.83),
    (-2.14, 106.11),
)

# Monitored port codes and the sample ports.
MONITORED_PORTS = ("SGSIN", "NLRTM", "USNYC", "CNSHA")
PORTS = (
    ("SGSIN", "Port of Singapore", "Singapore", 1.2644, 103.8542, "SGSIN", "Container Port", 50),
    ("IDTPP", "Tanjung Priok", "Indonesia", -6.1042, 106.8829, "IDTPP", "Container Port", 30),
    ("MYPKG", "Port Klang", "Malaysia", 3.0039, 101.3944, "MYPKG", "Container Port", 40),
)

RING = "array<struct<lon: double, lat: double>>"
FENCE_SCHEMA = (
    f"id int, name string, geofence_type string, rings array<{RING}>, "
    "is_active boolean, alert_on_entry boolean, alert_on_exit boolean"
)


def ring(*points: tuple[float, float]) -> list[dict[str, float]]:
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def box_ring(b: Box) -> list[dict[str, float]]:
    return ring((b.west, b.south), (b.east, b.south), (b.east, b.north), (b.west, b.north))


def sample_fences() -> list[tuple]:
    """The boxes as port fences, a concave restricted zone, and a fishing zone with a hole."""
    rows = [(i + 1, b.name, "PORT", [box_ring(b)], True, True, True) for i, b in enumerate(BOXES)]
    corner = ring((106.7, -6.2), (107.0, -6.2), (107.0, -6.1), (106.85, -6.1), (106.85, -6.0), (106.7, -6.0))
    rows.append((8, "Restricted-Corner", "RESTRICTED", [corner], True, True, False))
    outer = ring((112.55, -7.35), (112.95, -7.35), (112.95, -7.05), (112.55, -7.05))
    hole = ring((112.7, -7.25), (112.8, -7.25), (112.8, -7.15), (112.7, -7.15))
    rows.append((9, "Fishing-Ring", "FISHING", [outer, hole], True, False, True))
    rows.append((10, "Retired-Fence", "CUSTOM", [box_ring(BOXES[3])], False, True, True))
    return rows


def fences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sample_fences(), FENCE_SCHEMA)


def weather_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEATHER_POINTS), "latitude double, longitude double")


def box_name(lat: Column, lon: Column, boxes=BOXES) -> Column:
    """Name of the first box that holds the point, NULL outside all."""
    return F.coalesce(
        *[F.when(lat.between(b.south, b.north) & lon.between(b.west, b.east), F.lit(b.name)) for b in boxes]
    )


def in_any_box(lat: Column, lon: Column, boxes=BOXES) -> Column:
    """A plain disjunction of comparisons, so the scan can skip row groups on both coordinates."""
    held = F.lit(False)
    for b in boxes:
        held = held | (lat.between(b.south, b.north) & lon.between(b.west, b.east))
    return held
