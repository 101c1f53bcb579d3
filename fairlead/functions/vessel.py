"""Scalar rules on vessel attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Navigation status codes and their texts.
NAVIGATION_STATUS = {
    0: "Under way using engine",
    1: "At anchor",
    2: "Not under command",
    3: "Restricted manoeuverability",
    4: "Constrained by draught",
    5: "Moored",
    6: "Aground",
    7: "Engaged in fishing",
    8: "Under way sailing",
    15: "Not defined",
}

# Name fragments that tell the vessel type, first match wins.
NAME_FRAGMENTS = [
    ("PASSENGER", ("FERRY", "PELNI")),
    ("TANKER", ("TANKER", "MT ")),
    ("CARGO", ("CARGO", "MV ", "MS ")),
    ("FISHING", ("FISH",)),
]

# Expected top speed in knots by vessel type.
TOP_SPEED = {"CARGO": 25.0, "PASSENGER": 35.0, "TANKER": 20.0}
DEFAULT_TOP_SPEED = 25.0

# Display categories by substring of the type, first match wins.
TYPE_CATEGORIES = [
    ("cargo", ("cargo",)),
    ("tanker", ("tanker",)),
    ("passenger", ("passenger",)),
    ("fishing", ("fishing",)),
    ("tug", ("tug",)),
    ("pleasure", ("pleasure", "yacht")),
    ("sailing", ("sailing", "sail")),
    ("military", ("military",)),
]


def code_text(code: Column, texts: dict[int, str], unknown: str, other: str) -> Column:
    """Text of an integer code, from a fixed list."""
    literal = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.when(code.isNull(), F.lit(unknown)).otherwise(
        F.coalesce(F.try_element_at(literal, code.cast("int")), F.lit(other))
    )


def navigation_status_text(code: Column) -> Column:
    return code_text(code, NAVIGATION_STATUS, "Unknown", "Reserved")


def first_fragment(text: Column, rules: list[tuple[str, tuple[str, ...]]], otherwise: str) -> Column:
    """Name of the first rule one of whose fragments occurs in the text."""
    found = []
    for name, fragments in rules:
        hit = F.contains(text, F.lit(fragments[0]))
        for fragment in fragments[1:]:
            hit = hit | F.contains(text, F.lit(fragment))
        found.append(F.when(hit, F.lit(name)))
    return F.coalesce(*found, F.lit(otherwise))


def type_from_name(name: Column) -> Column:
    return F.when(name.isNull(), F.lit("UNKNOWN")).otherwise(first_fragment(F.upper(name), NAME_FRAGMENTS, "OTHER"))


def type_category(vessel_type: Column) -> Column:
    return first_fragment(F.lower(F.coalesce(vessel_type, F.lit("unknown"))), TYPE_CATEGORIES, "unknown")


def top_speed(vessel_type: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in TOP_SPEED.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, F.upper(vessel_type)), F.lit(DEFAULT_TOP_SPEED))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def completeness_score(
    name: Column,
    speed: Column,
    course: Column,
    heading: Column,
    navigation_status: Column,
    destination: Column,
    ts: Column,
    as_of: Column,
) -> Column:
    """0..100: deductions for missing optional fields and for age in whole minutes."""
    # Points lost per missing field and per age step.
    lost = (
        F.when(is_blank(name), 10).otherwise(0)
        + F.when(speed.isNull(), 10).otherwise(0)
        + F.when(course.isNull(), 10).otherwise(0)
        + F.when(heading.isNull(), 5).otherwise(0)
        + F.when(navigation_status.isNull(), 5).otherwise(0)
        + F.when(is_blank(destination), 10).otherwise(0)
    )
    minutes = F.floor((F.unix_millis(as_of) - F.unix_millis(ts)) / 60000)
    stale = F.when(minutes > 30, 20).when(minutes > 10, 10).otherwise(0)
    return F.greatest(F.lit(0), F.lit(100) - lost - stale)
