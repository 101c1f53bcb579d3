"""Decoding, routing and encoding. The JSON texts are derived from the driver's tables by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fairlead.functions import port, times
from fairlead.operators import ports as port_ops
from fairlead.operators import validate
from fairlead.plans import common, lenses
from fairlead.plans.oracle import sql
from fairlead.plans.registry import query
from fairlead.session import scratch_path
from fairlead.sources import files, wire

BROKEN, EMPTY = 97, 89


def envelope_texts(spark, sf):
    """Envelope texts of all positions; some are cut short, some carry no payload."""
    rows = lenses.positions(spark, sf)
    made = wire.envelopes(rows, common.newest(rows))
    seq = F.col("seq")
    return made.select(
        "seq",
        F.when(seq % BROKEN == 0, F.expr("substring(value, 1, length(value) div 2)"))
        .when(seq % EMPTY == 0, F.to_json(F.struct(F.col("key").alias("id"), F.lit("AIS_RAW").alias("dataType"))))
        .otherwise(F.col("value"))
        .alias("value"),
    )


REASON = f"CASE WHEN seq % {BROKEN} = 0 THEN 'PARSE_ERROR' WHEN seq % {EMPTY} = 0 THEN 'NO_PAYLOAD' END"


@query("S-03", "K-03", sql=sql(f"""
SELECT seq, reason, CASE WHEN reason IS NULL THEN mmsi END AS mmsi, CASE WHEN reason IS NULL THEN speed END AS speed,
  CASE WHEN reason IS NULL THEN status END AS status, CASE WHEN reason IS NULL THEN epoch_ms(ts) END AS ts_ms
FROM (SELECT *, {REASON} AS reason FROM positions)""", "positions"))
def decode_envelopes(spark, sf):
    rows = wire.positions_from_envelopes(envelope_texts(spark, sf))
    good = F.col("reject_reason").isNull()
    return rows.select(
        "seq", F.col("reject_reason").alias("reason"),
        *[F.when(good, F.col(c)).alias(c) for c in ("mmsi", "speed", "status")],
        F.when(good, F.unix_millis("ts")).alias("ts_ms"),
    )


@query("K-14", sql=sql(f"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN seq % {BROKEN} = 0 THEN 'PARSE_ERROR' WHEN seq % {EMPTY} = 0 THEN 'NO_PAYLOAD'
  WHEN speed > 102.3 THEN 'INVALID_SPEED' END AS reason FROM positions) WHERE reason IS NOT NULL GROUP BY reason""", "positions"))
def dead_letters(spark, sf):
    """Rejects of decoding and validation, written to their own table and read back."""
    rows = wire.positions_from_envelopes(envelope_texts(spark, sf))
    failed = validate.position_reject_reason(F.lit(None).cast("timestamp"), check_age=False)
    tagged = rows.withColumn("reject_reason", F.coalesce("reject_reason", failed))
    _, rejects = validate.split_rejects(tagged)
    path = scratch_path(spark, "rejects")
    rejects.write.parquet(path)
    return spark.read.parquet(path).groupBy(F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("S-04", sql=sql("""
SELECT seq, CASE WHEN seq % 10 = 7 THEN NULL ELSE mmsi END AS mmsi, CASE WHEN seq % 10 = 7 THEN NULL ELSE coalesce(vessel_name, 'Unknown') END AS vessel_name,
  CASE WHEN seq % 11 = 0 THEN 0e0 ELSE speed END AS speed, CASE WHEN seq % 13 = 0 THEN 0e0 ELSE course END AS course,
  CASE WHEN seq % 4 = 0 THEN NULL ELSE CAST(seq % 50 AS DOUBLE) + CASE WHEN seq % 3 = 0 THEN 0 ELSE 7 END END AS length,
  CASE seq % 3 WHEN 0 THEN epoch_ms(ts) WHEN 1 THEN epoch_ms(ts) // 1000 * 1000 ELSE epoch_ms((SELECT max(ts) FROM positions)) END AS ts_ms
FROM positions""", "positions"))
def decode_feed(spark, sf):
    """Raw feed texts with gaps: no metadata, speed, course or dimensions; three time spellings."""
    rows = lenses.positions(spark, sf)
    seq = F.col("seq")
    spelling = F.when(seq % 3 == 0, F.unix_millis("ts").cast("string")).when(
        seq % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.col("vessel_name").alias("ShipName"), F.col("call_sign").alias("CallSign"))
    report = F.struct(
        F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"),
        F.when(seq % 11 != 0, F.col("speed")).alias("Sog"),
        F.when(seq % 13 != 0, F.col("course")).alias("Cog"),
        F.col("heading").alias("TrueHeading"),
        spelling.alias("Timestamp"),
    )
    size = F.struct((seq % 50).cast("int").alias("A"), F.when(seq % 3 != 0, 7).alias("B"), F.lit(5).alias("C"))
    static = F.struct(F.col("destination").alias("Destination"), F.when(seq % 4 != 0, size).alias("Dimension"))
    text = F.to_json(
        F.struct(
            F.lit("PositionReport").alias("MessageType"),
            F.when(seq % 10 != 7, meta).alias("MetaData"),
            F.struct(report.alias("PositionReport"), static.alias("StaticDataReport")).alias("Message"),
        )
    )
    done = wire.positions_from_feed(rows.select("seq", text.alias("value")), common.newest(rows))
    return done.select("seq", "mmsi", "vessel_name", "speed", "course", "length", *common.millis("ts"))


@query("S-05", "S-11", sql=sql("""
SELECT seq, CASE WHEN l = 0 THEN '0_0' ELSE grid_id END AS grid_id, round(temperature, 6) AS temperature, wind_speed, CASE WHEN l = 1 THEN NULL ELSE 'Rain' END AS condition,
  CASE WHEN l = 2 THEN NULL ELSE humidity / 10 END AS precipitation,
  CASE WHEN l = 3 THEN epoch_ms((SELECT max(ts) FROM weather)) ELSE epoch_ms(ts) END AS ts_ms
FROM (SELECT *, CAST(round(pressure) AS INT) % 5 AS l FROM weather)""", "weather"))
def decode_weather(spark, sf):
    """Weather responses in envelopes; some lack coordinates, conditions, rain or a time."""
    rows = lenses.weather(spark, sf)
    lack = F.round("pressure").cast("int") % 5
    response = F.struct(
        F.when(lack != 0, F.struct(F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))).alias("coord"),
        F.when(lack != 1, F.array(F.struct(F.lit(500).alias("id"), F.lit("Rain").alias("main")))).alias("weather"),
        F.struct(F.col("temperature").alias("temp")).alias("main"),
        F.struct(F.col("wind_speed").alias("speed")).alias("wind"),
        F.when(lack != 2, F.struct((F.col("humidity") / 10).alias("1h"))).alias("rain"),
        F.when(lack != 3, F.unix_seconds("ts")).alias("dt"),
    )
    messages = rows.select("seq", F.to_json(response).alias("value"))
    done = wire.weather_from_source(messages, common.newest(rows))
    return done.select(
        "seq", "grid_id", *common.rounded("temperature"), "wind_speed", "condition", "precipitation", *common.millis("ts")
    )


@query("S-11", sql=sql("""
SELECT grid_id, count(*) AS n, round(avg(temperature), 6) AS avg_temperature FROM weather WHERE sea_state <> 3 GROUP BY grid_id""", "weather"))
def unwrap_weather(spark, sf):
    """Envelopes without a payload are dropped."""
    rows = lenses.weather(spark, sf)
    payload = F.when(F.col("sea_state") != 3, F.struct("grid_id", "temperature", "wind_speed"))
    messages = rows.select(F.to_json(F.struct(F.lit("WEATHER").alias("dataType"), payload.alias("parsedData"))).alias("value"))
    inner = wire.unwrapped(messages, "grid_id: STRING, temperature: DOUBLE, wind_speed: DOUBLE")
    return inner.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("n"), common.near(F.avg("temperature")).alias("avg_temperature")
    )


@query("S-06", sql=sql("""
SELECT seq, CASE seq % 6 WHEN 0 THEN epoch_ms(ts) WHEN 1 THEN epoch_ms(ts) // 1000 * 1000 WHEN 2 THEN epoch_ms(ts) WHEN 3 THEN epoch_ms(ts) // 1000 * 1000
    WHEN 4 THEN epoch_ms((SELECT max(ts) FROM positions)) END AS ts_ms,
  CASE seq % 6 WHEN 1 THEN epoch_ms(ts) // 1000 WHEN 2 THEN epoch_ms(ts) WHEN 3 THEN epoch_ms(ts) // 1000 * 1000 END AS eta_ms,
  CASE WHEN seq % 6 = 3 THEN epoch_ms(ts) // 1000 * 1000 ELSE epoch_ms((SELECT max(ts) FROM positions)) END AS weather_ms
FROM positions""", "positions"))
def normalise_instants(spark, sf):
    """Six spellings of a time: seconds with fraction, seconds, milliseconds, ISO text, missing, unreadable."""
    rows = lenses.positions(spark, sf)
    kind, ms = F.col("seq") % 6, F.unix_millis("ts")
    bare = (
        F.when(kind == 0, wire.instant_text(F.col("ts")))
        .when(kind == 1, F.floor(ms / 1000).cast("string"))
        .when(kind == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 5, "abc")
    )
    spelling = F.when(kind == 2, ms.cast("string")).when(kind != 4, F.concat(F.lit('"'), bare, F.lit('"')))
    text = F.concat(F.lit('{"mmsi": 1'), F.coalesce(F.concat(F.lit(', "timestamp": '), spelling), F.lit("")), F.lit("}"))
    now = common.newest(rows)
    as_spelled = wire.spelled(F.col("value"), "timestamp")
    plain = F.when(kind != 2, F.get_json_object("value", "$.timestamp"))
    return rows.withColumn("value", text).select(
        "seq",
        times.instant_millis(as_spelled, now).alias("ts_ms"),
        times.eta_millis(as_spelled).alias("eta_ms"),
        times.weather_millis(plain, now).alias("weather_ms"),
    )


def _payloads(spark, sf):
    """Events as position, port and weather payloads, as another object, and as no object at all."""
    kind, seq = F.col("event_type"), F.col("event_id")
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = [F.when(seq % 7 != 0, F.lit(1.5)).otherwise(F.lit(95.0)).alias("latitude"), F.lit(104.0).alias("longitude"), ts.alias("timestamp")]
    text = (
        F.when(kind == "view", F.to_json(F.struct(F.col("user_id").alias("mmsi"), *place)))
        .when(kind == "click", F.to_json(F.struct(F.lit("SGSIN").alias("port_code"), *place)))
        .when(kind == "signup", F.to_json(F.struct(F.col("value").alias("temperature"), *place)))
        .when(kind == "purchase", F.to_json(F.struct(F.lit(80).alias("sea"), *place)))
        .otherwise("not a json")
    )
    return lenses.table(spark, sf, "events").select(seq.alias("seq"), text.alias("value"))


KIND = "CASE event_type WHEN 'view' THEN 'AIS' WHEN 'click' THEN 'PORT' WHEN 'signup' THEN 'WEATHER' ELSE 'UNKNOWN' END"


@query("S-07", "X-02", sql=f"SELECT event_id AS seq, {KIND} AS payload_type FROM events")
def payload_routing(spark, sf):
    return wire.with_payload_type(_payloads(spark, sf)).select("seq", "payload_type")


@query("S-08", "X-02", sql=f"""
SELECT payload_type, reason, count(*) AS n FROM (SELECT {KIND} AS payload_type,
  CASE WHEN {KIND} = 'UNKNOWN' THEN 'NO_PARSER' WHEN event_id % 7 = 0 OR ({KIND} = 'AIS' AND user_id = 0) THEN 'INVALID_' || {KIND} ELSE 'GOOD' END AS reason FROM events)
GROUP BY payload_type, reason""")
def parse_payloads(spark, sf):
    """Every text goes to the decoder of its type; good and rejected rows per type."""
    parts = [
        rows.select(F.lit(kind).alias("payload_type"), F.coalesce("reject_reason", F.lit("GOOD")).alias("reason"))
        for kind, rows in wire.routed(_payloads(spark, sf)).items()
    ]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy("payload_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("S-08", "S-07", "X-02", sql=f"""
SELECT event_id AS seq, {KIND} AS payload_type, CASE WHEN {KIND} = 'UNKNOWN' THEN 'NO_PARSER' WHEN event_id % 7 = 0 OR ({KIND} = 'AIS' AND user_id = 0) THEN 'INVALID_' || {KIND} END AS reason,
  CASE WHEN {KIND} IN ('AIS', 'PORT', 'WEATHER') THEN CASE WHEN event_id % 7 <> 0 THEN 1.5e0 ELSE 95e0 END END AS latitude,
  CASE WHEN {KIND} = 'AIS' THEN user_id END AS mmsi, CASE WHEN {KIND} = 'WEATHER' THEN value END AS temperature FROM events""")
def split_payloads(spark, sf):
    """Decoded rows of every type, from messages that are looked at once."""
    split = wire.split_by_type(_payloads(spark, sf), scratch_path(spark, "payloads"))
    names = {"latitude": "double", "mmsi": "bigint", "temperature": "double"}
    parts = [
        rows.select("seq", F.lit(kind).alias("payload_type"), F.col("reject_reason").alias("reason"),
                    *[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in names.items()])
        for kind, rows in split.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("S-09", sql=sql("""
SELECT 525000001 + c_custkey AS mmsi, c_name AS vessel_name, 9000000 + c_custkey AS imo, 'YB' || c_custkey AS call_sign, CAST(c_custkey % 90 AS INT) AS type_code,
  round(c_custkey % 90 / 1e1, 6) AS latitude FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0"""))
def vessel_file_scan(spark, sf):
    """A pipe-separated vessel file with a header, comments, short rows and bad numbers, written and scanned."""
    key = F.col("c_custkey")
    fields = [
        (key + lenses.MMSI_BASE).cast("string"), F.col("c_name"), (key + 9_000_000).cast("string"),
        F.concat(F.lit("YB"), key.cast("string")),
        F.when(key % 17 == 0, "x").otherwise((key % 90).cast("string")), (key % 90 / 10.0).cast("string"), F.lit("104.5"),
    ]
    lines = lenses.table(spark, sf, "customer").select(
        F.when(key % 19 == 0, F.concat(F.lit("# "), F.col("c_name")))
        .when(key % 13 == 0, F.concat_ws("|", *fields))
        .otherwise(F.concat_ws("|", *fields, F.lit("Java Sea")))
        .alias("value")
    )
    header = spark.createDataFrame(
        [("MMSI|Ship Name|IMO|Call Sign|Type Code|Latitude|Longitude|Area",), ("",)], "value string"
    )
    path = scratch_path(spark, "vessel-file")
    header.unionByName(lines).write.text(path)
    done = files.vessel_file(spark, path)
    return done.select("mmsi", "vessel_name", "imo", "call_sign", "type_code", common.near(F.col("latitude")).alias("latitude"))


def _loose_texts(spark, sf):
    """Positions as texts with quoted numbers, missing fields and two spellings."""
    seq = F.col("seq")
    body = F.struct(
        F.col("mmsi").cast("string").alias("mmsi"),
        F.col("vessel_name").alias("vesselName"),
        F.when(seq % 2 == 0, F.col("speed").cast("string")).alias("speed"),
        F.when(seq % 2 == 1, F.col("speed")).alias("sog"),
        F.when(seq % 5 != 0, F.col("heading")).alias("heading"),
    )
    return lenses.positions(spark, sf).select("seq", F.to_json(body).alias("value"))


LOOSE = {"mmsi": ("bigint", "mmsi"), "vessel_name": ("string", "vesselName"), "speed": ("double", "speed", "sog"),
         "heading": ("int", "heading")}


@query("S-12", sql=sql("SELECT seq, mmsi, vessel_name, speed, CASE WHEN seq % 5 <> 0 THEN heading END AS heading FROM positions", "positions"))
def typed_fields_state(spark, sf):
    return wire.typed_fields(_loose_texts(spark, sf), LOOSE, blanks=False)


@query("S-12", sql=sql("SELECT seq, mmsi, coalesce(vessel_name, '') AS vessel_name, speed, CASE WHEN seq % 5 <> 0 THEN heading ELSE 0 END AS heading FROM positions", "positions"))
def typed_fields_history(spark, sf):
    return wire.typed_fields(_loose_texts(spark, sf), LOOSE, blanks=True)


@query("S-13", sql=sql("SELECT seq, mmsi, vessel_name, speed FROM positions", "positions"))
def double_encoded(spark, sf):
    """Every other text arrives as a JSON string that holds the JSON document."""
    texts = _loose_texts(spark, sf)
    wrapped = F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('\\"')), F.lit('"'))
    mixed = texts.withColumn("value", F.when(F.col("seq") % 2 == 0, wrapped).otherwise(F.col("value")))
    return wire.typed_fields(wire.unquoted(mixed), {k: LOOSE[k] for k in ("mmsi", "vessel_name", "speed")}, blanks=False)


@query("K-01", "S-06", sql=sql("""
SELECT mmsi, speed, course, heading, epoch_ms(ts) AS ts_ms, round(dist, 6) AS distance_nm, dt AS elapsed_ms, vessel_type FROM enriched""", "enriched"))
def topic_positions(spark, sf):
    """Enriched positions in wire form (numbers and instants as texts), read back into types."""
    messages = wire.to_topic(common.enriched(spark, sf), wire.POSITION_NAMES).select("value")
    rows = wire.positions_from_topic(messages, F.lit(None).cast("timestamp"))
    return rows.select(
        "mmsi", "speed", "course", "heading", *common.millis("ts"),
        common.near(F.col("distance_from_previous")).alias("distance_nm"),
        F.col("time_since_last_update").alias("elapsed_ms"), "vessel_type",
    )


@query("K-02", sql=sql("SELECT CAST(mmsi AS VARCHAR) AS key, alert_type, severity, mmsi AS involved, ms AS ts_ms FROM alerts", "alerts"))
def topic_alerts(spark, sf):
    messages = wire.to_topic(common.alerts(spark, sf), wire.ALERT_NAMES)
    return messages.select(
        "key",
        F.get_json_object("value", "$.alertType").alias("alert_type"),
        F.get_json_object("value", "$.severity").alias("severity"),
        F.get_json_object("value", "$.involvedMMSIs[0]").cast("bigint").alias("involved"),
        times.instant_millis(wire.spelled(F.col("value"), "alertTime"), F.lit(None).cast("timestamp")).alias("ts_ms"),
    )


@query("K-03", sql=sql("""
SELECT CAST(mmsi AS VARCHAR) AS key, count(*) AS n, sum(CASE WHEN destination IS NULL THEN 1 ELSE 0 END)::BIGINT AS without_destination FROM positions GROUP BY mmsi""", "positions"))
def publish_envelopes(spark, sf):
    """Keyed messages; the key is the vessel, so one vessel stays in order."""
    rows = lenses.positions(spark, sf)
    made = wire.envelopes(rows, common.newest(rows))
    missing = F.get_json_object("value", "$.parsedData.destination").isNull()
    return made.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("without_destination"))


def _snapshots(spark, sf):
    """Orders as port snapshots with one schedule entry each, by way of their JSON text."""
    ts = F.col("o_orderdate").cast("timestamp")
    key = F.col("o_orderkey")

    def iso(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    entry = F.struct(
        (F.col("o_custkey") + lenses.MMSI_BASE).alias("mmsi"),
        F.when(key % 2 == 0, "arrival").otherwise("DEPARTURE").alias("event_type"),
        iso(ts).alias("scheduled_time"),
        iso(F.timestamp_micros(F.unix_micros(ts) + (key % 90 - 30) * 60_000_000)).alias("estimated_time"),
        F.col("o_orderstatus").alias("status"),
    )
    facilities = F.when(key % 3 == 0, F.array(F.lit("Container"), F.lit("Bunkering"))).otherwise(F.array(F.lit("Container")))
    body = F.struct(
        F.concat(F.lit("P"), (F.col("o_custkey") % 25).cast("string")).alias("port_code"),
        F.lit("Port").alias("port_name"),
        F.array(entry).alias("schedules"),
        F.when(key % 5 != 0, facilities).alias("facilities"),
        iso(ts).alias("timestamp"),
    )
    texts = lenses.table(spark, sf, "orders").select(key.alias("seq"), F.to_json(body).alias("value"))
    return wire.port_snapshots(texts)


@query("O-10", sql="""
SELECT sha256('P' || (o_custkey % 25) || '|' || (o_custkey + 525000001) || '|' || CASE WHEN o_orderkey % 2 = 0 THEN 'arrival' ELSE 'DEPARTURE' END || '|' || (epoch_us(o_orderdate) // 1000)) AS operation_id,
  'P' || (o_custkey % 25) AS port_id, o_custkey + 525000001 AS mmsi, CASE WHEN o_orderkey % 2 = 0 THEN 'ARRIVAL' ELSE 'DEPARTURE' END AS operation_type,
  CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) // 1000 + (o_orderkey % 90 - 30) * 60000 END AS arrival_time_ms, o_orderstatus AS status
FROM orders""")
def port_schedule_ops(spark, sf):
    done = port_ops.schedule_operations(_snapshots(spark, sf))
    return done.select("operation_id", "port_id", "mmsi", "operation_type", *common.millis("arrival_time"), "status")


@query("O-11", sql="""
SELECT o_orderstatus AS status, o_orderkey % 90 - 30 AS delay_minutes, o_orderkey % 90 - 30 > 0 AS delayed, count(*) AS n FROM orders GROUP BY ALL""")
def schedule_delays(spark, sf):
    done = port_ops.with_delay(port_ops.schedule_operations(_snapshots(spark, sf)))
    return done.groupBy("status", "delay_minutes", "delayed").agg(F.count(F.lit(1)).alias("n"))


@query("O-12", sql="""
SELECT 'P' || (o_custkey % 25) AS port_code, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) AS with_bunkering, count(*) AS n FROM orders GROUP BY 1""")
def port_facilities(spark, sf):
    rows = _snapshots(spark, sf)
    return rows.groupBy("port_code").agg(
        F.count_if(port.has_facility(F.col("facilities"), "Bunkering")).alias("with_bunkering"), F.count(F.lit(1)).alias("n")
    )
