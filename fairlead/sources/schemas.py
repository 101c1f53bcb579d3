"""Declared schemas of the JSON documents. Nothing is inferred."""

RAW_FEED = """
MessageType STRING,
MetaData STRUCT<MMSI: BIGINT, ShipName: STRING, IMO: BIGINT, CallSign: STRING, ShipType: INT, time_utc: STRING,
  latitude: DOUBLE, longitude: DOUBLE>,
Message STRUCT<
  PositionReport: STRUCT<Latitude: DOUBLE, Longitude: DOUBLE, Sog: DOUBLE, Cog: DOUBLE, TrueHeading: INT,
    NavigationalStatus: INT, Timestamp: STRING, RateOfTurn: INT, SpecialManoeuvreIndicator: INT>,
  StaticDataReport: STRUCT<Destination: STRING, Eta: STRING, Dimension: STRUCT<A: INT, B: INT, C: INT, D: INT>,
    MaximumStaticDraught: DOUBLE>>
"""

PARSED_POSITION = (
    "valid: BOOLEAN, navigationStatusDescription: STRING, mmsi: BIGINT, imo: STRING, vessel_name: STRING, "
    "call_sign: STRING, latitude: DOUBLE, longitude: DOUBLE, speed: DOUBLE, course: DOUBLE, heading: INT, "
    "navigation_status: INT, vessel_type: INT, length: DOUBLE, width: DOUBLE, draught: DOUBLE, "
    "destination: STRING, eta: STRING, flag_country: STRING, timestamp: TIMESTAMP, source: STRING, rot: DOUBLE"
)

ENVELOPE = (
    "id STRING, dataType STRING, collectorId STRING, timestamp TIMESTAMP, rawData STRING, "
    f"parsedData STRUCT<{PARSED_POSITION}>, metadata MAP<STRING, STRING>, qualityScore INT, source STRING"
)

POSITION = PARSED_POSITION.replace(":", "")

WEATHER_SOURCE = """
coord STRUCT<lon: DOUBLE, lat: DOUBLE>,
weather ARRAY<STRUCT<id: INT, main: STRING, description: STRING, icon: STRING>>,
base STRING,
main STRUCT<temp: DOUBLE, feels_like: DOUBLE, temp_min: DOUBLE, temp_max: DOUBLE, pressure: INT, humidity: INT,
  sea_level: INT, grnd_level: INT>,
visibility INT,
wind STRUCT<speed: DOUBLE, deg: INT, gust: DOUBLE>,
rain STRUCT<`1h`: DOUBLE, `3h`: DOUBLE>,
clouds STRUCT<all: INT>,
dt BIGINT,
sys STRUCT<type: INT, id: BIGINT, country: STRING, sunrise: BIGINT, sunset: BIGINT>,
timezone INT, id BIGINT, name STRING, cod INT
"""

PORT_SNAPSHOT = """
port_code STRING, port_name STRING, country_code STRING, latitude DOUBLE, longitude DOUBLE, timezone STRING,
status STRING, berth_count INT, vessels_in_port INT, expected_arrivals INT, expected_departures INT,
congestion_level INT, avg_wait_time DOUBLE, max_vessel_length DOUBLE, max_draught DOUBLE, facilities ARRAY<STRING>,
schedules ARRAY<STRUCT<mmsi: BIGINT, vessel_name: STRING, imo: STRING, event_type: STRING,
  scheduled_time: TIMESTAMP, estimated_time: TIMESTAMP, actual_time: TIMESTAMP, berth_number: STRING,
  cargo_type: STRING, status: STRING>>,
tide_info STRUCT<current_height: DOUBLE, next_high_tide: TIMESTAMP, next_low_tide: TIMESTAMP,
  high_tide_height: DOUBLE, low_tide_height: DOUBLE>,
contact_email STRING, contact_phone STRING, website STRING, timestamp TIMESTAMP, source STRING
"""
