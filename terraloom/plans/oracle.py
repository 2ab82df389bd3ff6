"""SQL forms of the derived tables, for checking results."""

from __future__ import annotations

from ..functions import tags as T
from ..functions.levels import thresholds
from ..operators.fleet import VEHICLES
from .derive import AS_OF_TEXT, WAY_HIGHWAYS, WAY_SPEEDS


def lat_of(k: str) -> str:
    return f"(50e0 + 3e0 * ((({k}) * 7919) % 10007) / 10007e0)"


def lon_of(k: str) -> str:
    return f"(3e0 + 5e0 * ((({k}) * 104729) % 10009) / 10009e0)"


def hash01(k: str, seed: str | int = 0) -> str:
    return f"(((CAST({k} AS BIGINT) * 2654435761 + CAST({seed} AS BIGINT) * 40503) % 4294967296) / 4294967296e0)"


def hav(a: str, b: str, c: str, d: str, r: str = "6371000e0") -> str:
    h = (f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))")
    return f"(2 * {r} * atan2(sqrt({h}), sqrt(greatest(1 - {h}, 0e0))))"


def merc_x(lon: str) -> str:
    return f"(radians({lon}) * 6378137e0)"


def merc_y(lat: str) -> str:
    return f"(ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137e0)"


def box(lat: str = "lat", lon: str = "lon") -> str:
    return f"('R' || lpad(CAST(CAST(floor(({lat} - 50e0) / 0.6e0) * 5 + floor({lon} - 3e0) AS BIGINT) AS VARCHAR), 2, '0'))"


def listed(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def level(xp: str) -> str:
    return f"CAST(greatest(len(list_filter([{', '.join(map(str, thresholds()))}], lambda t: t <= {xp})) - 1, 0) AS INTEGER)"


def group_case(h: str) -> str:
    arms = " ".join(f"WHEN {h} IN {listed(v)} THEN '{k}'" for k, v in T.HIGHWAY_GROUPS.items())
    return f"CASE {arms} ELSE '{T.OTHER_GROUP}' END"


def posted(rule: str = "leading") -> str:
    if rule == "leading":
        v = r"TRY_CAST(nullif(regexp_extract(lower(maxspeed), '^\s*([0-9.]+)', 1), '') AS DOUBLE)"
        v = f"(CASE WHEN {v} > 0 THEN {v} END)"
    else:
        bare = "trim(replace(replace(trim(lower(maxspeed)), 'km/h', ''), 'kph', ''))"
        v = rf"TRY_CAST(regexp_extract({bare}, '^(\S+)', 1) AS DOUBLE)"
    return f"(CASE WHEN lower(maxspeed) LIKE '%mph%' THEN {v} * 1.609344e0 ELSE {v} END)"


def profile_kmh() -> str:
    default = "CASE " + " ".join(f"WHEN highway = '{h}' THEN {k}" for h, k in T.DEFAULT_KMH.items()) + f" ELSE {T.DEFAULT_OTHER_KMH} END"
    base = f"coalesce(CAST(floor({posted()}) AS INTEGER), {default})"
    arms = [f"WHEN highway IN {listed(v)} THEN {k}" for k, v in T.PROFILE_FIXED_KMH.items()]
    arms += [f"WHEN highway IN {listed(v)} THEN least({base}, {k})" for k, v in T.PROFILE_CAP_KMH.items()]
    return f"(CASE {' '.join(arms)} ELSE {base} END)"


NCUST = "(SELECT count(*) FROM customer)"
AS_OF = f"TIMESTAMP '{AS_OF_TEXT}'"
VEHICLE_TIER = "[" + ", ".join(str(v[5]) for v in VEHICLES) + "]"

PARTS = {
    "addr": f"addr AS (SELECT c_custkey AS id, c_mktsegment AS city, {lat_of('c_custkey')} AS lat, {lon_of('c_custkey')} AS lon FROM customer)",
    "raddr": f"raddr AS (SELECT *, {box()} AS region FROM addr)",
    "refs": (
        "refs AS (SELECT l_orderkey AS way_id, "
        "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, node_id) - 1 AS pos, node_id "
        "FROM (SELECT *, l_partkey * 100 + CAST(l_suppkey * 7 + l_quantity AS BIGINT) % 100 AS node_id FROM lineitem))"
    ),
    "way": (
        "way AS (SELECT o_orderkey AS id, o_orderstatus AS status, "
        f"CASE WHEN o_orderstatus <> 'F' THEN {sql_list(WAY_HIGHWAYS)}[CAST(o_orderkey % 12 AS INTEGER) + 1] END AS highway, "
        "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'private' END AS access, "
        f"CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 7 < 6 THEN {sql_list(WAY_SPEEDS)}[CAST(o_orderkey % 7 AS INTEGER) + 1] END AS maxspeed, "
        "CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 5 = 0 THEN 'yes' WHEN o_orderkey % 5 = 1 THEN '-1' END AS oneway, "
        "CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'house' ELSE 'warehouse' END END AS building, "
        "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS city "
        "FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"
    ),
    "route_way": f"route_way AS (SELECT * FROM way WHERE highway IN {listed(T.ROUTABLE_HIGHWAYS)} AND coalesce(access, '') NOT IN ('no', 'private'))",
    "node": (
        "node AS (SELECT id, p_size % 4 AS kind, p_name, p_brand, p_type, "
        f"{lat_of('id')} AS lat, {lon_of('id')} AS lon FROM (SELECT DISTINCT node_id AS id FROM refs) JOIN part ON p_partkey = id // 100)"
    ),
    "pair": (
        "pair AS (SELECT way_id, pos AS seq, node_id AS src, dst FROM (SELECT way_id, pos, node_id, "
        "lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS dst FROM refs) WHERE dst IS NOT NULL)"
    ),
    "road_pair": "road_pair AS (SELECT pair.*, w.highway, w.maxspeed, w.oneway FROM pair JOIN route_way w ON w.id = pair.way_id)",
    "car_pair": "car_pair AS (SELECT pair.*, w.highway, w.maxspeed, w.oneway FROM pair JOIN way w ON w.id = pair.way_id WHERE w.highway IS NOT NULL)",
    "edge": (
        "edge AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(way_id) AS way_id, arg_max(highway, way_id) AS highway "
        "FROM road_pair GROUP BY 1, 2)"
    ),
    "job": (
        f"job AS (SELECT o_orderkey AS job_id, o_custkey AS start_address, (o_custkey * 31 + 7) % {NCUST} AS end_address, "
        "CAST(o_orderkey % 8 + 1 AS INTEGER) AS tier, CAST(o_orderkey % 9 AS INTEGER) AS category, o_totalprice / 10000e0 AS km, "
        f"{merc_x(lon_of('o_custkey'))} AS x, {merc_y(lat_of('o_custkey'))} AS y FROM orders)"
    ),
    "emp": (
        "emp AS (SELECT s_suppkey AS employee_id, CAST(s_nationkey AS BIGINT) AS game_id, CAST(s_suppkey % 14 AS INTEGER) AS vehicle_level, "
        "CAST(greatest(floor(s_acctbal * 100), 0) AS BIGINT) AS xp, "
        f"{lat_of('s_suppkey + 5000011')} AS lat, {lon_of('s_suppkey + 5000011')} AS lon FROM supplier)"
    ),
    "active": (
        "active AS (SELECT event_id AS active_id, user_id AS employee_id, user_id % 25 AS game_id, event_id % 700 AS job_id, "
        "CASE WHEN event_type <> 'view' THEN ts END AS start_time, value * 3600e0 AS duration_s, value AS reward, "
        "CAST(floor(value * 10) AS BIGINT) AS xp, CAST(event_id % 9 AS INTEGER) AS category, "
        f"event_id % {NCUST} AS pickup, (event_id * 31 + 7) % {NCUST} AS delivery, "
        f"{lat_of('event_id + 77')} AS start_lat, {lon_of('event_id + 77')} AS start_lon FROM events)"
    ),
    "eemp": (
        "eemp AS (SELECT employee_id, employee_id % 25 AS game_id, CAST(employee_id % 14 AS INTEGER) AS vehicle_level, employee_id * 1000 AS xp, "
        f"{lat_of('employee_id + 5000011')} AS lat, {lon_of('employee_id + 5000011')} AS lon FROM (SELECT DISTINCT user_id AS employee_id FROM events))"
    ),
    "egame": (
        "egame AS (SELECT game_id, 1000e0 AS money, game_id * 100 AS xp0, CAST(50 AS BIGINT) AS xp3, 1e0 + 0.25e0 * (game_id % 3) AS xpm "
        "FROM (SELECT DISTINCT user_id % 25 AS game_id FROM events))"
    ),
    "ugame": (
        "ugame AS (SELECT user_id AS game_id, CAST(event_id % 9 AS INTEGER) AS category, CAST(sum(floor(value)) AS BIGINT) * 3000 AS xp, count(*) AS n "
        "FROM events GROUP BY 1, 2)"
    ),
    "travel": (
        "travel AS (SELECT event_id AS travel_id, user_id AS employee_id, ts AS start_time, value * 3600e0 AS duration_s, "
        f"{lat_of('event_id + 991')} AS to_lat, {lon_of('event_id + 991')} AS to_lon FROM events WHERE event_type = 'click')"
    ),
    "poly": (
        "poly AS (SELECT *, " + lat_of("p + seq * 13") + " AS lat, " + lon_of("p + seq * 13") + " AS lon FROM (SELECT l_orderkey AS route_id, "
        "row_number() OVER w - 1 AS seq, sum(l_quantity) OVER w AS cum_time_s, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) OVER w AS BIGINT) AS cum_dist_m, "
        "CAST(l_partkey % 100 + 10 AS DOUBLE) AS max_speed_kmh, l_linestatus = 'O' AS is_walking, l_partkey AS p FROM lineitem "
        "WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)))"
    ),
}


def with_(parts: str, body: str) -> str:
    """``body`` after the named derived tables."""
    named = [PARTS[p] for p in parts.split()]
    return "WITH " + ", ".join(named) + " " + body
