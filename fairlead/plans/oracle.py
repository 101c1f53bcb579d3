"""Building blocks of the SQL twins: the lenses as common table expressions, and scalar rules as SQL text."""

from __future__ import annotations

import re

from fairlead.functions import geo, vessel, weather
from fairlead.plans import lenses
from fairlead.sources.reference import BOXES, sample_fences


def real(x: float) -> str:
    return f"{float(x)!r}e0"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(xs) -> str:
    return "[" + ", ".join(real(x) if isinstance(x, float) else text(x) for x in xs) + "]"


def hav(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = geo.EARTH_RADIUS_NM) -> str:
    a = (
        f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"({real(2.0 * radius)} * atan2(sqrt({a}), sqrt(greatest(0e0, 1 - {a}))))"


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return hav(lat1, lon1, lat2, lon2, geo.EARTH_RADIUS_KM)


def case(subject: str, pairs: dict, otherwise: str) -> str:
    arms = " ".join(f"WHEN {k if isinstance(k, int) else text(k)} THEN {v if isinstance(v, (int, float)) else text(v)}"
                    for k, v in pairs.items())
    return f"(CASE {subject} {arms} ELSE {otherwise} END)"


def nav_text(code: str) -> str:
    return f"(CASE WHEN {code} IS NULL THEN 'Unknown' ELSE {case(code, vessel.NAVIGATION_STATUS, text('Reserved'))} END)"


def sea_text(code: str) -> str:
    return f"(CASE WHEN {code} IS NULL THEN 'Unknown' ELSE {case(code, weather.SEA_STATE, text('Invalid'))} END)"


def fragment_case(subject: str, rules, otherwise: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({subject}, {text(f)})" for f in fragments) + f" THEN {text(name)}"
        for name, fragments in rules
    )
    return f"(CASE {arms} ELSE {text(otherwise)} END)"


def type_of(name: str) -> str:
    return f"(CASE WHEN {name} IS NULL THEN 'UNKNOWN' ELSE {fragment_case(f'upper({name})', vessel.NAME_FRAGMENTS, 'OTHER')} END)"


def top(kind: str) -> str:
    return f"(CASE upper({kind}) WHEN 'PASSENGER' THEN 35e0 WHEN 'TANKER' THEN 20e0 ELSE 25e0 END)"


def angle(a: str, b: str) -> str:
    turn = f"((({a}) - ({b})) - 360 * floor((({a}) - ({b})) / 360))"
    return f"least({turn}, 360 - {turn})"


def bearing(lat1, lon1, lat2, lon2) -> str:
    raw = f"(degrees(atan2(({lon2}) - ({lon1}), ({lat2}) - ({lat1}))) + 360)"
    return f"({raw} - 360 * floor({raw} / 360))"


def _positions(name: str, compression: int) -> str:
    base = lenses.EPOCH_2024_US
    names = " ".join(f"WHEN {i} THEN {text(n)}" for i, n in enumerate(lenses.VESSEL_NAMES))
    code = case("event_type", lenses.STATUS_BY_EVENT, "15")
    lat0, lon0 = values([(b.south + b.north) / 2 for b in BOXES]), values([(b.west + b.east) / 2 for b in BOXES])
    return f"""{name} AS (
  SELECT user_id + {lenses.MMSI_BASE} AS mmsi,
    (CASE user_id % 6 {names} END) || CAST(user_id AS VARCHAR) AS vessel_name,
    'IMO' || CAST(user_id + 9000000 AS VARCHAR) AS imo,
    'YB' || CAST(user_id AS VARCHAR) AS call_sign,
    ({lat0})[CAST(user_id % 7 AS INT) + 1] + ((user_id * 7919) % 200 - 100) / 1e3 + ((event_id * 13) % 50 - 25) / 2e3 AS latitude,
    ({lon0})[CAST(user_id % 7 AS INT) + 1] + ((user_id * 10473) % 200 - 100) / 1e3 + ((event_id * 17) % 70 - 35) / 2e3 AS longitude,
    value AS speed,
    CAST((event_id * 37) % 360 AS DOUBLE) AS course,
    TRY_CAST(json_extract_string(props, '$.k') AS INT) AS heading,
    {code} AS navigation_status,
    {nav_text(code)} AS status,
    CASE WHEN user_id % 4 <> 0 THEN ({values([b.name for b in BOXES])})[CAST(user_id % 7 AS INT) + 1] END AS destination,
    make_timestamp({base} + (epoch_us(ts) - {base}) // {compression}) AS ts,
    event_id AS seq
  FROM events)"""


OPEN_FENCES = [f for f in sample_fences() if f[4]]


def _fence_edges() -> str:
    rows = []
    for fence in OPEN_FENCES:
        for points in fence[3]:
            for p, q in zip(points, points[1:] + points[:1]):
                rows.append(f"({fence[0]}, {real(p['lon'])}, {real(p['lat'])}, {real(q['lon'])}, {real(q['lat'])})")
    return "edges(fence_id, x1, y1, x2, y2) AS (VALUES " + ", ".join(rows) + ")"


def _fence_names() -> str:
    rows = [f"({f[0]}, {text(f[1])}, {text(f[2])}, {f[4]}, {f[5]}, {f[6]})" for f in sample_fences()]
    return "fences(fence_id, fence_name, geofence_type, is_active, alert_on_entry, alert_on_exit) AS (VALUES " + ", ".join(rows) + ")"


def hits_of(source: str, name: str = "hits") -> str:
    """Rows of a position relation with every fence that holds them: an odd number of edges to the east."""
    crossing = "((y1 > p.latitude) <> (y2 > p.latitude)) AND p.longitude < (x2 - x1) * (p.latitude - y1) / (CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END) + x1"
    return f"""{name} AS (
  SELECT p.mmsi, p.seq, p.ts, fence_id FROM {source} p, edges
  GROUP BY p.mmsi, p.seq, p.ts, fence_id
  HAVING count(*) FILTER (WHERE {crossing}) % 2 = 1)"""


CTES = {
    "positions": _positions("positions", lenses.COMPRESSION),
    "positions_long": _positions("positions_long", 1),
    "valid": f"valid AS (SELECT *, {type_of('vessel_name')} AS vessel_type FROM positions WHERE speed BETWEEN 0 AND 102.3)",
    "valid_long": f"valid_long AS (SELECT *, {type_of('vessel_name')} AS vessel_type FROM positions_long WHERE speed BETWEEN 0 AND 102.3)",
    "enriched": f"""enriched AS (
  SELECT *, epoch_ms(ts) - epoch_ms(prev_ts) AS dt, {hav('prev_lat', 'prev_lon', 'latitude', 'longitude')} AS dist
  FROM (SELECT *, lag(latitude) OVER w AS prev_lat, lag(longitude) OVER w AS prev_lon, lag(speed) OVER w AS prev_speed,
          lag(course) OVER w AS prev_course, lag(ts) OVER w AS prev_ts
        FROM valid WINDOW w AS (PARTITION BY mmsi ORDER BY ts, seq)))""",
    "checks": f"""checks AS (
  SELECT *, speed > 1.5 * {top('vessel_type')} AND prev_speed IS NOT NULL AS is_fast,
    prev_speed > 10 AND speed < 1.0 AS is_stop,
    coalesce(abs(speed - prev_speed) / (CASE WHEN dt = 0 THEN NULL ELSE dt / 1e3 END) > 1.0, false) AS is_jump
  FROM enriched)""",
    "candidates": """candidates AS (
  SELECT *, CASE WHEN is_fast THEN 'EXCESSIVE_SPEED' WHEN is_stop THEN 'SUDDEN_STOP' ELSE 'IMPOSSIBLE_ACCELERATION' END AS alert_type,
    epoch_ms(ts) AS ms
  FROM checks WHERE is_fast OR is_stop OR is_jump)""",
    # Greedy throttle by recursion: the next alert of a vessel is the first candidate more than 300 s later.
    "chain": """chain AS (
  SELECT mmsi, min(ms) AS ms FROM candidates GROUP BY mmsi
  UNION ALL
  SELECT c.mmsi, min(c.ms) FROM chain JOIN candidates c ON c.mmsi = chain.mmsi AND c.ms > chain.ms + 300000 GROUP BY c.mmsi, chain.ms)""",
    "alerts": """alerts AS (
  SELECT c.*, CASE alert_type WHEN 'EXCESSIVE_SPEED' THEN 'HIGH' WHEN 'SUDDEN_STOP' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    CASE alert_type WHEN 'EXCESSIVE_SPEED' THEN 4 WHEN 'SUDDEN_STOP' THEN 3 ELSE 2 END AS severity_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, ms ORDER BY seq) AS at_ms FROM candidates) c
  JOIN chain USING (mmsi, ms) WHERE at_ms = 1)""",
    "vessels": f"""vessels AS (
  SELECT c_custkey + {lenses.MMSI_BASE} AS mmsi, c_name AS vessel_name,
    'IMO' || CAST(c_custkey + 9000000 AS VARCHAR) AS imo_number, 'YB' || CAST(c_custkey AS VARCHAR) AS callsign,
    {case('c_mktsegment', lenses.TYPE_BY_SEGMENT, text('OTHER'))} AS vessel_type, n_name AS flag_state,
    CAST(c_custkey % 200 + 50 AS DOUBLE) AS length, CAST(c_custkey % 30 + 10 AS DOUBLE) AS width,
    {lenses.EPOCH_2024_US // 1000} + c_custkey % 48 * 3600000 AS eta_ms, (c_custkey % 24 + 8) / 2e0 AS draught
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "operations": f"""operations AS (
  SELECT 'OP' || CAST(o_orderkey AS VARCHAR) AS operation_id, 'P' || CAST(c_nationkey AS VARCHAR) AS port_id,
    n_name AS port_name, o_custkey % 150 + {lenses.MMSI_BASE} AS mmsi,
    'VESSEL ' || CAST(o_custkey % 150 AS VARCHAR) AS vessel_name,
    CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'ARRIVAL' WHEN o_orderpriority[1] IN ('3', '4') THEN 'DEPARTURE' ELSE 'SHIFT' END AS operation_type,
    'B' || CAST(o_orderkey % 12 AS VARCHAR) AS berth_number, o_orderdate AS arrival_time,
    make_timestamp(epoch_us(o_orderdate) + (o_orderkey % 48) * 3600000000) AS departure_time,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'SCHEDULED' ELSE 'IN_PROGRESS' END AS status,
    o_orderdate AS ts, o_orderkey AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "weather": """weather AS (
  SELECT CAST(CAST(floor(latitude * 10 + 0.5) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(longitude * 10 + 0.5) AS BIGINT) AS VARCHAR) AS grid_id, *
  FROM (SELECT -9e0 + (l_suppkey % 120) / 1e1 AS latitude, 98e0 + (l_partkey % 33) AS longitude,
    20e0 + l_discount * 100 AS temperature, l_quantity / 2 AS wind_speed,
    CAST((l_partkey * 7) % 360 AS DOUBLE) AS wind_direction, l_tax * 60 AS wave_height, 1e2 * l_quantity AS visibility,
    1e3 + l_linenumber AS pressure, 4e1 + l_quantity AS humidity, CAST(l_orderkey % 10 AS INT) AS sea_state,
    make_timestamp(epoch_us(l_shipdate) + (l_orderkey % 24) * 3600000000 + l_linenumber * 1000000) AS ts,
    CAST(l_orderkey * 8 + l_linenumber AS HUGEINT) * 1000000000000000000 + l_partkey * 100000000 + l_suppkey AS seq FROM lineitem))""",
    "edges": _fence_edges(),
    "fences": _fence_names(),
    "hits": hits_of("valid"),
}

ORDER = list(CTES)
NEEDS = {
    "valid": {"positions"},
    "valid_long": {"positions_long"},
    "enriched": {"valid"},
    "checks": {"enriched"},
    "candidates": {"checks"},
    "chain": {"candidates"},
    "alerts": {"chain", "candidates"},
    "hits": {"valid", "edges"},
}


def rewrite(statement: str, function: str, change) -> str:
    """Replace every call of a function by ``change(argument text)``, inner calls first."""
    done, rest, head = "", statement, f"{function}("
    while (found := re.search(rf"(?<!\w){re.escape(head)}", rest)) is not None:
        start = end = found.end()
        depth = 1
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        done += rest[: found.start()] + change(rewrite(rest[start : end - 1], function, change))
        rest = rest[end:]
    return done + rest


def whole_millis(arguments: str) -> str:
    """``epoch_ms(x)`` rounds; the rules here cut."""
    return f"(epoch_us({arguments}) // 1000)"


def nudged(arguments: str) -> str:
    """Engines round exact halves differently, so both sides move off them before rounding to some digits."""
    value, comma, digits = arguments.rpartition(",")
    if comma and digits.strip().isdigit():
        return f"round({value} + 1e-9,{digits})"
    return f"round({arguments})"


def sql(body: str, *ctes: str, extra: str = "") -> str:
    """A SELECT over the named relations; ``extra`` holds further common table expressions."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        wanted.add(name)

    for c in ctes:
        add(c)
    # Expressions used more than once are worked out once.
    parts = [CTES[c].replace(" AS (", " AS MATERIALIZED (", 1) if c in MATERIALISED else CTES[c] for c in ORDER if c in wanted]
    if extra:
        parts.append(extra)
    recursive = "RECURSIVE " if "chain" in wanted or "/* recursive */" in extra else ""
    statement = (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body
    return rewrite(rewrite(statement, "epoch_ms", whole_millis), "round", nudged)


MATERIALISED = {"candidates", "chain", "alerts"}
