"""Scalar rules on weather measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.functions.vessel import code_text

# Sea state codes and their texts.
SEA_STATE = {
    0: "Calm (glassy) - 0m",
    1: "Calm (rippled) - 0-0.1m",
    2: "Smooth (wavelets) - 0.1-0.5m",
    3: "Slight - 0.5-1.25m",
    4: "Moderate - 1.25-2.5m",
    5: "Rough - 2.5-4m",
    6: "Very rough - 4-6m",
    7: "High - 6-9m",
    8: "Very high - 9-14m",
    9: "Phenomenal - 14m+",
}


def sea_state_text(code: Column) -> Column:
    return code_text(code, SEA_STATE, "Unknown", "Invalid")


def safe_for_navigation(visibility: Column, sea_state: Column, wind_speed: Column) -> Column:
    """Unknown measures are not safe."""
    return F.coalesce((visibility > 1000) & (sea_state <= 6) & (wind_speed < 20), F.lit(False))


def weather_score(safe: Column) -> Column:
    return F.when(safe, 100).otherwise(70)


def weather_condition(wave: Column, wind: Column, visibility: Column, humidity: Column) -> Column:
    """Struct(type, intensity) for display."""

    def condition(kind: str, intensity: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.least(F.lit(1.0), intensity).alias("intensity"))

    return (
        F.when((wave > 4) | (wind > 20), condition("stormy", (wave + wind / 10) / 8))
        .when(visibility < 2, condition("foggy", (5 - visibility) / 5))
        .when((humidity > 80) & (wind > 5), condition("rainy", humidity / 100))
        .when(humidity > 60, condition("cloudy", humidity / 80))
        .otherwise(condition("clear", F.lit(0.2)))
    )
