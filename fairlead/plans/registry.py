"""The query library: each entry is a Spark query over the driver's tables and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Build
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(*covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a function under its own name."""

    def add(build: Build) -> Build:
        if build.__name__ in CATALOG:
            raise ValueError(f"{build.__name__} is registered twice")
        CATALOG[build.__name__] = Query(build.__name__, covers, build, sql)
        return build

    return add


def load() -> dict[str, Query]:
    from fairlead.plans import alerts, ingest, reads, rollups, scalars, sequences, spatial, streams, writes  # noqa: F401

    return CATALOG
