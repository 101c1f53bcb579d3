"""JSON in and out: decoding, routing by payload type, reject rows, and the wire form of the sinks.

All functions take a table with the text in ``value`` and work on batch and streaming tables alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import geo, times, vessel
from fairlead.operators import validate
from fairlead.sources import schemas

CORRUPT = "_corrupt_record"


def parsed(value: Column, ddl: str) -> Column:
    """Struct of the declared fields, with the text of a broken document in ``_corrupt_record``."""
    return F.from_json(
        value, f"{ddl}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )


def positions_from_envelopes(messages: DataFrame) -> DataFrame:
    """Flatten envelopes to positions. Broken text and missing payloads stay as rows with a ``reject_reason``."""
    # As a generated row: a filter on what is made of it does not pull the parser below itself, once for every field it names.
    rows = messages.select("*", F.explode(F.array(parsed(F.col("value"), schemas.ENVELOPE))).alias("_e"))
    broken = F.col("_e").isNull() | F.col(f"_e.{CORRUPT}").isNotNull()
    reason = F.when(broken, "PARSE_ERROR").when(F.col("_e.parsedData").isNull(), "NO_PAYLOAD")
    p = "_e.parsedData."
    return rows.select(
        *[c for c in messages.columns if c != "value"],
        *[
            F.col(p + c).alias(c)
            for c in ("mmsi", "vessel_name", "imo", "call_sign", "latitude", "longitude", "speed", "course", "heading")
        ],
        F.col(p + "navigationStatusDescription").alias("status"),
        F.col(p + "timestamp").alias("ts"),
        F.col("_e.timestamp").alias("collection_time"),
        F.col("_e.collectorId").alias("source"),
        F.col("_e.collectorId").alias("collector_id"),
        reason.alias("reject_reason"),
        F.when(reason.isNotNull(), F.col("value")).alias("rejected_value"),
    )


def unwrapped(messages: DataFrame, payload_ddl: str) -> DataFrame:
    """Payload columns of envelopes that carry one."""
    inner = F.from_json("value", f"parsedData STRUCT<{payload_ddl}>")["parsedData"]
    return messages.withColumn("_p", inner).where(F.col("_p").isNotNull()).select("_p.*")


def positions_from_feed(messages: DataFrame, as_of: Column) -> DataFrame:
    """Flatten raw feed messages to positions, with the feed's defaults."""
    rows = messages.withColumn("_m", F.from_json("value", schemas.RAW_FEED))
    meta, report, static = "_m.MetaData", "_m.Message.PositionReport", "_m.Message.StaticDataReport"
    has_meta, has_report = F.col(meta).isNotNull(), F.col(report).isNotNull()
    size = F.col(f"{static}.Dimension")

    def extent(a: str, b: str) -> Column:
        total = F.coalesce(size[a], F.lit(0)) + F.coalesce(size[b], F.lit(0))
        return F.when(size.isNotNull(), total.cast("double"))

    return rows.select(
        *[c for c in messages.columns if c != "value"],
        F.col(f"{meta}.MMSI").alias("mmsi"),
        F.when(has_meta, F.coalesce(F.col(f"{meta}.ShipName"), F.lit("Unknown"))).alias("vessel_name"),
        F.col(f"{meta}.IMO").cast("string").alias("imo"),
        F.col(f"{meta}.CallSign").alias("call_sign"),
        F.col(f"{meta}.ShipType").alias("ship_type"),
        F.col(f"{report}.Latitude").alias("latitude"),
        F.col(f"{report}.Longitude").alias("longitude"),
        F.when(has_report, F.coalesce(F.col(f"{report}.Sog"), F.lit(0.0))).alias("speed"),
        F.when(has_report, F.coalesce(F.col(f"{report}.Cog"), F.lit(0.0))).alias("course"),
        F.col(f"{report}.TrueHeading").alias("heading"),
        F.col(f"{report}.NavigationalStatus").alias("navigation_status"),
        F.col(f"{static}.Destination").alias("destination"),
        extent("A", "B").alias("length"),
        extent("C", "D").alias("width"),
        F.timestamp_millis(times.feed_millis(F.col(f"{report}.Timestamp"), as_of)).alias("ts"),
    )


def weather_from_source(messages: DataFrame, as_of: Column) -> DataFrame:
    """Flatten weather responses: first condition, one-hour rain, grid cell, time from epoch seconds."""
    rows = messages.withColumn("_w", F.from_json("value", schemas.WEATHER_SOURCE))
    lat = F.coalesce(F.col("_w.coord.lat"), F.lit(0.0))
    lon = F.coalesce(F.col("_w.coord.lon"), F.lit(0.0))
    first = F.try_element_at(F.col("_w.weather"), F.lit(1))
    return rows.select(
        *[c for c in messages.columns if c != "value"],
        geo.weather_cell(lat, lon).alias("grid_id"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.col("_w.name").alias("location_name"),
        F.col("_w.main.temp").alias("temperature"),
        F.col("_w.main.feels_like").alias("feels_like"),
        F.col("_w.main.pressure").alias("pressure"),
        F.col("_w.main.humidity").alias("humidity"),
        F.col("_w.visibility").alias("visibility"),
        F.col("_w.wind.speed").alias("wind_speed"),
        F.col("_w.wind.deg").alias("wind_direction"),
        F.col("_w.wind.gust").alias("wind_gust"),
        first["main"].alias("condition"),
        first["id"].alias("condition_code"),
        F.col("_w.clouds.all").alias("cloudiness"),
        F.col("_w.rain.1h").alias("precipitation"),
        F.coalesce(F.timestamp_seconds("_w.dt"), as_of).alias("ts"),
    )


def port_snapshots(messages: DataFrame) -> DataFrame:
    rows = messages.withColumn("_p", F.from_json("value", schemas.PORT_SNAPSHOT))
    return rows.select(*[c for c in messages.columns if c != "value"], "_p.*").withColumnRenamed("timestamp", "ts")


def looks_like_object(text: Column) -> Column:
    return F.startswith(F.trim(text), F.lit("{")) & F.endswith(F.trim(text), F.lit("}"))


def mentions(text: Column, *fields: str) -> Column:
    held = F.lit(False)
    for name in fields:
        held = held | F.contains(text, F.lit(f'"{name}"'))
    return looks_like_object(text) & held


@dataclass(frozen=True)
class Decoder:
    """A payload type: how to recognise its text, its schema, and what makes a decoded row valid."""

    payload_type: str
    recognises: Callable[[Column], Column]
    ddl: str
    valid: Callable[[], Column]


def decoders() -> list[Decoder]:
    """Position, port and weather payloads, in the order in which they are tried."""
    # The fields whose presence marks a payload type.
    return [
        Decoder("AIS", lambda v: mentions(v, "mmsi", "MMSI"), schemas.POSITION, validate.ingest_ok),
        Decoder("PORT", lambda v: mentions(v, "port_code", "port_name", "berth_count"), schemas.PORT_SNAPSHOT,
                validate.port_ok),
        Decoder("WEATHER", lambda v: mentions(v, "temperature", "wind_speed", "weather"),
                "latitude DOUBLE, longitude DOUBLE, temperature DOUBLE, wind_speed DOUBLE, visibility DOUBLE, "
                "sea_state INT, timestamp TIMESTAMP", validate.located_ok),
    ]


def with_payload_type(messages: DataFrame, known: list[Decoder] | None = None) -> DataFrame:
    """``payload_type`` of each text, ``UNKNOWN`` where no decoder recognises it."""
    found = [F.when(d.recognises(F.col("value")), F.lit(d.payload_type)) for d in known or decoders()]
    return messages.withColumn("payload_type", F.coalesce(*found, F.lit("UNKNOWN")))


def decoded(messages: DataFrame, decoder: Decoder) -> DataFrame:
    """Rows of one payload type: payload columns, ``ts``, and a ``reject_reason`` for unreadable or invalid ones."""
    keep = [c for c in messages.columns if c not in ("value", "payload_type")]
    rows = messages.withColumn("_d", parsed(F.col("value"), decoder.ddl))
    flat = rows.select(*keep, "value", "_d.*").withColumnRenamed("timestamp", "ts")
    return flat.withColumn(
        "reject_reason",
        F.when(F.col(CORRUPT).isNotNull(), "PARSE_ERROR").when(~decoder.valid(), f"INVALID_{decoder.payload_type}"),
    ).drop(CORRUPT, "value")


def split_by_type(messages: DataFrame, folder: str, known: list[Decoder] | None = None) -> dict[str, DataFrame]:
    """What :func:`routed` returns, with one look at the messages: they are dealt into a folder per type, and each
    decoder opens its own. The texts nobody recognises stay in theirs."""
    chosen, spark = known or decoders(), messages.sparkSession
    typed = with_payload_type(messages, chosen)
    typed.write.mode("overwrite").partitionBy("payload_type").parquet(folder)
    dealt = spark.read.schema(typed.schema).parquet(folder)
    own = lambda kind: dealt.where(F.col("payload_type") == kind)
    tables = {d.payload_type: decoded(own(d.payload_type), d) for d in chosen}
    tables["UNKNOWN"] = own("UNKNOWN").withColumn("reject_reason", F.lit("NO_PARSER"))
    return tables


def routed(messages: DataFrame, known: list[Decoder] | None = None) -> dict[str, DataFrame]:
    """One decoded table per payload type, plus ``UNKNOWN`` with the texts nobody recognises."""
    chosen = known or decoders()
    typed = with_payload_type(messages, chosen)
    tables = {
        d.payload_type: decoded(typed.where(F.col("payload_type") == d.payload_type), d) for d in chosen
    }
    tables["UNKNOWN"] = typed.where(F.col("payload_type") == "UNKNOWN").withColumn(
        "reject_reason", F.lit("NO_PARSER")
    )
    return tables


# What a missing field becomes: NULL in current-state tables, an empty value in history and alert tables.
BLANKS = {"string": "", "int": 0, "bigint": 0, "double": 0.0}


def typed_fields(messages: DataFrame, fields: dict[str, tuple[str, ...]], blanks: bool) -> DataFrame:
    """Read named fields out of JSON text, whether numbers are quoted or not.

    ``fields`` maps a column to its type followed by the spellings, names of the outermost level, to try in order. The
    text is parsed once for all of them.
    """
    names = list(dict.fromkeys(s for _, *spellings in fields.values() for s in spellings))
    at = {s: f"_field{i}" for i, s in enumerate(names)}
    read = messages.select("*", F.json_tuple("value", *names).alias(*at.values()))
    columns = []
    for name, (kind, *spellings) in fields.items():
        text = F.coalesce(*[F.col(at[s]) for s in spellings])
        typed = text if kind == "string" else text.try_cast(kind)
        columns.append((F.coalesce(typed, F.lit(BLANKS[kind])) if blanks else typed).alias(name))
    return read.select(*[c for c in messages.columns if c != "value"], *columns)


def unquoted(messages: DataFrame) -> DataFrame:
    """Undo one level of double encoding: a JSON text inside a JSON string becomes the inner text."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    return messages.withColumn(
        "value", F.when(F.startswith(F.trim("value"), F.lit('"')), inner).otherwise(F.col("value"))
    )


def spelled(value: Column, name: str) -> Column:
    """A scalar field as spelled in the document: texts come with quotes, numbers without."""
    return F.to_json(F.try_variant_get(F.try_parse_json(value), f"$.{name}", "variant"))


# --- wire form of the sinks ---------------------------------------------------------------------------------


def instant_text(ts: Column) -> Column:
    """Epoch seconds with a nine-digit fraction."""
    micros = F.unix_micros(ts)
    whole = F.floor(micros / 1_000_000).cast("bigint")
    return F.concat(
        whole.cast("string"), F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("000")
    )


def wire_value(rows: DataFrame, names: dict[str, str]) -> Column:
    """JSON text of the named columns: numbers as strings, instants as seconds in a string, NULL left out."""
    kinds = dict(rows.dtypes)
    fields = []
    for column, name in names.items():
        kind = kinds[column]
        if kind.startswith("timestamp"):
            c = instant_text(F.col(column))
        elif kind in ("int", "bigint", "double", "float", "smallint") or kind.startswith("decimal"):
            c = F.col(column).cast("string")
        else:
            c = F.col(column)
        fields.append(c.alias(name))
    return F.to_json(F.struct(*fields))


POSITION_NAMES = {
    "mmsi": "mmsi", "vessel_name": "vesselName", "imo": "imo", "call_sign": "callSign", "latitude": "latitude",
    "longitude": "longitude", "speed": "speed", "course": "course", "heading": "heading", "status": "status",
    "vessel_type": "vesselType", "flag": "flag", "destination": "destination",
    "distance_from_previous": "distanceFromPrevious", "time_since_last_update": "timeSinceLastUpdate",
    "ts": "timestamp", "source": "source", "validated": "validated", "validation_status": "validationStatus",
    "grid_cell": "gridCell",
}
ALERT_NAMES = {
    "alert_id": "alertId", "alert_type": "alertType", "severity": "severity", "mmsi": "mmsi",
    "vessel_name": "vesselName", "involved_mmsis": "involvedMMSIs", "latitude": "latitude",
    "longitude": "longitude", "title": "title", "description": "description", "details": "details",
    "detected_at": "detectedAt", "ts": "alertTime", "action_required": "actionRequired",
    "acknowledged": "acknowledged",
}


# Wire names of what the persistence jobs store of the other topics.
STORED_ALERT_NAMES = {
    "alert_id": "alertId", "alert_type": "alertType", "severity": "severity", "mmsi": "mmsi", "vessel_name": "vesselName",
    "latitude": "latitude", "longitude": "longitude", "title": "title", "description": "description", "ts": "timestamp",
    "seq": "sequence",
}
WEATHER_NAMES = {
    "grid_id": "gridId", "latitude": "latitude", "longitude": "longitude", "temperature": "temperature",
    "wind_speed": "windSpeed", "wind_direction": "windDirection", "wave_height": "waveHeight", "visibility": "visibility",
    "pressure": "pressure", "humidity": "humidity", "sea_state": "seaState", "ts": "timestamp", "seq": "sequence",
}
PORT_OPERATION_NAMES = {
    "operation_id": "operationId", "port_id": "portId", "port_name": "portName", "mmsi": "mmsi", "vessel_name": "vesselName",
    "operation_type": "operationType", "berth_number": "berthNumber", "arrival_time": "arrivalTime",
    "departure_time": "departureTime", "status": "status", "ts": "timestamp", "seq": "sequence",
}


def from_topic(messages: DataFrame, names: dict[str, str], kinds: dict[str, str]) -> DataFrame:
    """Typed rows of topic texts, encoded once or twice; what is missing or unreadable is NULL.

    ``kinds`` are the types of the columns. Instants may be spelled in any of the ways that messages use.
    """
    plain = unquoted(messages)
    instants = [c for c in names if kinds[c].startswith("timestamp")]
    timed = plain.withColumns(
        {c: F.timestamp_millis(times.instant_millis(spelled(F.col("value"), names[c]), F.lit(None).cast("timestamp"))) for c in instants}
    )
    rows = typed_fields(timed, {c: (kinds[c], n) for c, n in names.items() if c not in instants}, blanks=False)
    return rows.select(*names)


def to_topic(rows: DataFrame, names: dict[str, str], key: str = "mmsi") -> DataFrame:
    """Keyed messages (key, value), ready for a Kafka sink or JSON-line files."""
    held = {c: n for c, n in names.items() if c in rows.columns}
    return rows.select(F.col(key).cast("string").alias("key"), wire_value(rows, held).alias("value"))


def positions_from_topic(messages: DataFrame, as_of: Column) -> DataFrame:
    """Read the wire form back into typed position rows."""
    kinds = {
        "mmsi": "bigint", "latitude": "double", "longitude": "double", "speed": "double", "course": "double",
        "heading": "int", "distance_from_previous": "double", "time_since_last_update": "bigint",
    }
    fields = {
        c: (kinds.get(c, "string"), n)
        for c, n in POSITION_NAMES.items()
        if c not in ("ts", "validated")
    }
    with_time = messages.withColumn(
        "ts", F.timestamp_millis(times.instant_millis(spelled(F.col("value"), "timestamp"), as_of))
    )
    return typed_fields(with_time, fields, blanks=False)


def envelopes(positions: DataFrame, as_of: Column, collector: str = "ais-collector") -> DataFrame:
    """Positions wrapped as envelope texts, keyed by vessel: what the collector publishes."""
    payload = F.struct(
        F.lit(True).alias("valid"),
        F.col("status").alias("navigationStatusDescription"),
        *[
            F.col(c)
            for c in ("mmsi", "imo", "vessel_name", "call_sign", "latitude", "longitude", "speed", "course", "heading",
                      "navigation_status", "destination")
        ],
        F.col("ts").alias("timestamp"),
        "source",
    )
    score = vessel.completeness_score(
        F.col("vessel_name"), F.col("speed"), F.col("course"), F.col("heading"), F.col("navigation_status"),
        F.col("destination"), F.col("ts"), as_of,
    )
    body = F.struct(
        F.sha2(F.concat_ws("|", F.lit(collector), "mmsi", F.unix_micros("ts"), "seq"), 256).alias("id"),
        F.lit("AIS_RAW").alias("dataType"),
        F.lit(collector).alias("collectorId"),
        F.col("ts").alias("timestamp"),
        payload.alias("parsedData"),
        F.create_map(F.lit("seq"), F.col("seq").cast("string")).alias("metadata"),
        score.alias("qualityScore"),
        "source",
    )
    text = F.to_json(body, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})
    return positions.select(F.col("mmsi").cast("string").alias("key"), text.alias("value"), "seq")
