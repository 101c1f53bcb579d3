"""The driver's tables seen as vessel, weather and port tables.

Integer and double arithmetic only, so that a SQL engine reading the same files sees the same values. Every
lens is a projection (or an equi-join to master data) over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.vessel import navigation_status_text
from fairlead.session import prepare
from fairlead.sources.reference import BOXES

MMSI_BASE = 525_000_001
EPOCH_2024_US = 1_704_067_200_000_000
# 30 days of events become one hour.
COMPRESSION = 720

STATUS_BY_EVENT = {"view": 0, "click": 1, "signup": 5, "error": 2, "purchase": 8}
VESSEL_NAMES = ("KM PELNI ", "MT PERTAMINA ", "MV MERATUS ", "FISH JAYA ", "SINAR ")
TYPE_BY_SEGMENT = {"AUTOMOBILE": "CARGO", "BUILDING": "TANKER", "FURNITURE": "PASSENGER", "HOUSEHOLD": "FISHING"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def by_text(text: Column, pairs: dict, otherwise) -> Column:
    return F.coalesce(*[F.when(text == k, F.lit(v)) for k, v in pairs.items()], F.lit(otherwise))


def positions_from_events(events: DataFrame, compression: int = COMPRESSION) -> DataFrame:
    """Positions of vessels around seven harbours; also usable on a streaming ``events`` table."""
    user, event = F.col("user_id"), F.col("event_id")
    box = user % 7
    lat0 = lookup([(b.south + b.north) / 2 for b in BOXES], box)
    lon0 = lookup([(b.west + b.east) / 2 for b in BOXES], box)
    lat = lat0 + ((user * 7919) % 200 - 100) / F.lit(1000.0) + ((event * 13) % 50 - 25) / F.lit(2000.0)
    lon = lon0 + ((user * 10473) % 200 - 100) / F.lit(1000.0) + ((event * 17) % 70 - 35) / F.lit(2000.0)
    micros = F.expr(
        f"{EPOCH_2024_US} + (unix_micros(cast(ts as timestamp)) - {EPOCH_2024_US}) div {int(compression)}"
    )
    code = by_text(F.col("event_type"), STATUS_BY_EVENT, 15)
    return events.select(
        (user + MMSI_BASE).alias("mmsi"),
        F.concat(lookup([*VESSEL_NAMES, None], user % 6), user.cast("string")).alias("vessel_name"),
        F.concat(F.lit("IMO"), (user + 9_000_000).cast("string")).alias("imo"),
        F.concat(F.lit("YB"), user.cast("string")).alias("call_sign"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.col("value").alias("speed"),
        ((event * 37) % 360).cast("double").alias("course"),
        F.get_json_object("props", "$.k").try_cast("int").alias("heading"),
        code.alias("navigation_status"),
        navigation_status_text(code).alias("status"),
        F.when(user % 4 != 0, lookup([b.name for b in BOXES], box)).alias("destination"),
        F.timestamp_micros(micros).alias("ts"),
        event.alias("seq"),
        F.lit("events").alias("source"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense: one hour."""
    return positions_from_events(table(spark, sf_dir, "events"))


def positions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fixes over thirty days."""
    return positions_from_events(table(spark, sf_dir, "events"), compression=1)


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel master. Nations are a fixed list of 25 rows."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        (key + MMSI_BASE).alias("mmsi"),
        F.col("c_name").alias("vessel_name"),
        F.concat(F.lit("IMO"), (key + 9_000_000).cast("string")).alias("imo_number"),
        F.concat(F.lit("YB"), key.cast("string")).alias("callsign"),
        by_text(F.col("c_mktsegment"), TYPE_BY_SEGMENT, "OTHER").alias("vessel_type"),
        F.col("n_name").alias("flag_state"),
        (key % 200 + 50).cast("double").alias("length"),
        (key % 30 + 10).cast("double").alias("width"),
        F.timestamp_micros(F.lit(EPOCH_2024_US) + (key % 48) * 3_600_000_000).alias("eta"),
        ((key % 24 + 8) / F.lit(2.0)).alias("draught"),
    )


def port_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as port operations: the customer's nation is the port."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    ports = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "n_name"
    )
    priority = F.substring("o_orderpriority", 1, 1)
    ts = F.col("o_orderdate").cast("timestamp")
    return orders.join(ports, "o_custkey").select(
        F.concat(F.lit("OP"), F.col("o_orderkey").cast("string")).alias("operation_id"),
        F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("port_id"),
        F.col("n_name").alias("port_name"),
        (F.col("o_custkey") % 150 + MMSI_BASE).alias("mmsi"),
        F.concat(F.lit("VESSEL "), (F.col("o_custkey") % 150).cast("string")).alias("vessel_name"),
        F.when(priority.isin("1", "2"), "ARRIVAL")
        .when(priority.isin("3", "4"), "DEPARTURE")
        .otherwise("SHIFT")
        .alias("operation_type"),
        F.concat(F.lit("B"), (F.col("o_orderkey") % 12).cast("string")).alias("berth_number"),
        ts.alias("arrival_time"),
        F.timestamp_micros(F.unix_micros(ts) + (F.col("o_orderkey") % 48) * 3_600_000_000).alias("departure_time"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED")
        .when(F.col("o_orderstatus") == "O", "SCHEDULED")
        .otherwise("IN_PROGRESS")
        .alias("status"),
        ts.alias("ts"),
        F.col("o_orderkey").alias("seq"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as weather readings on a tenth-degree grid."""
    items = table(spark, sf_dir, "lineitem")
    lat = F.lit(-9.0) + (F.col("l_suppkey") % 120) / F.lit(10.0)
    lon = F.lit(98.0) + (F.col("l_partkey") % 33)
    quantity, line = F.col("l_quantity"), F.col("l_linenumber")
    hour = (F.col("l_orderkey") % 24) * 3_600_000_000 + line * 1_000_000
    return items.select(
        geo.weather_cell(lat, lon).alias("grid_id"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        (F.lit(20.0) + F.col("l_discount") * 100).alias("temperature"),
        (quantity / 2).alias("wind_speed"),
        ((F.col("l_partkey") * 7) % 360).cast("double").alias("wind_direction"),
        (F.col("l_tax") * 60).alias("wave_height"),
        (F.lit(100.0) * quantity).alias("visibility"),
        (F.lit(1000.0) + line).alias("pressure"),
        (F.lit(40.0) + quantity).alias("humidity"),
        (F.col("l_orderkey") % 10).cast("int").alias("sea_state"),
        F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + hour).alias("ts"),
        # Order keys repeat line numbers, so the sequence takes all four keys.
        F.expr(
            "cast(l_orderkey * 8 + l_linenumber as decimal(19, 0)) * 1000000000000000000BD"
            " + cast(l_partkey * 100000000 + l_suppkey as decimal(19, 0))"
        ).alias("seq"),
    )
