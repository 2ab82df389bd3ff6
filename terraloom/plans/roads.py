"""Queries over map elements, the road network, components and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import elements as EL
from ..operators import jobroutes as JR
from ..operators import network as NW
from ..operators import regions as RG
from ..operators import reports as RP
from ..operators import roadblocks as RB
from ..operators import routing as RT
from ..operators import ways as WY
from ..operators.ranking import top_n_rest
from . import derive as D
from .oracle import box, hash01, group_case, hav, lat_of, listed, lon_of, posted, profile_kmh, with_
from .registry import query


# --- elements --------------------------------------------------------------

ELEMENT_KINDS = {"node": "n", "way": "w", "relation": "r"}
NODE_ADDR = "SELECT id, 1 AS is_building, 1 AS is_addr, 0 AS is_relation, 1 AS is_node, 0 AS is_way, lat, lon, p_brand AS city FROM node WHERE kind = 2"
CENTER = "center AS (SELECT way_id AS id, avg(n.lat) AS lat, avg(n.lon) AS lon, count(*) AS located FROM refs JOIN node n ON n.id = node_id GROUP BY 1)"
WAY_ADDR = "SELECT w.id, 1, 1, 0, 0, 1, c.lat, c.lon, w.city FROM way w JOIN center c USING (id) WHERE w.building IS NOT NULL"
REL_ADDR = (
    "SELECT o_custkey, 1, 1, 1, 0, 0, sum(c.lat * c.located) / sum(c.located), sum(c.lon * c.located) / sum(c.located), any_value(c_mktsegment) "
    "FROM orders JOIN center c ON c.id = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0 GROUP BY 1"
)


@query("extract_addresses", with_("refs way node", "SELECT").removesuffix(" SELECT") + f", {CENTER}, a AS ({NODE_ADDR} UNION ALL {WAY_ADDR} UNION ALL {REL_ADDR}) "
       "SELECT id, is_building, is_addr, is_relation, is_node, is_way, round(lat, 6) AS lat, round(lon, 6) AS lon, city FROM a")
def _(spark, sf):
    a = EL.extract_addresses(D.osm(spark, sf))
    return a.select("id", "is_building", "is_addr", "is_relation", "is_node", "is_way", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "city")


@query("address_tags_json", with_("refs node", "SELECT id, '{\"addr:city\":\"' || p_brand || '\",\"addr:street\":\"' || p_name || '\",\"building\":\"house\"}' AS tags FROM node WHERE kind = 2"))
def _(spark, sf):
    return EL.extract_addresses(D.osm(spark, sf), "none").select("id", "tags")


@query("way_point_middle", with_("refs way node", "SELECT r.way_id AS id, round(n.lat, 6) AS lat, round(n.lon, 6) AS lon FROM refs r JOIN node n ON n.id = r.node_id "
       "JOIN (SELECT way_id, count(*) AS c FROM refs GROUP BY 1) k USING (way_id) JOIN way w ON w.id = r.way_id WHERE r.pos = k.c // 2"))
def _(spark, sf):
    o = D.osm(spark, sf)
    return EL.way_points(o.ways, o.nodes, "middle").select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("way_point_first", with_("refs way node", "SELECT r.way_id AS id, round(n.lat, 6) AS lat, round(n.lon, 6) AS lon FROM refs r JOIN node n ON n.id = r.node_id "
       "JOIN way w ON w.id = r.way_id WHERE r.pos = 0"))
def _(spark, sf):
    o = D.osm(spark, sf)
    return EL.way_points(o.ways, o.nodes, "first").select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("address_fields", with_("refs node", "SELECT id, CASE WHEN kind = 2 THEN p_name END AS street, CAST(NULL AS VARCHAR) AS house_number, CAST(NULL AS VARCHAR) AS postcode, CASE WHEN kind = 2 THEN p_brand END AS city FROM node"))
def _(spark, sf):
    return EL.with_address_fields(D.nodes(spark, sf)).select("id", "street", "house_number", "postcode", "city")


NODE_OF = hav("a.lat", "a.lon", "n.lat", "n.lon")


@query("addresses_with_nodes", with_("refs way pair car_pair addr", "SELECT").removesuffix(" SELECT") + f", rnode AS (SELECT DISTINCT n AS id, {lat_of('n')} AS lat, {lon_of('n')} AS lon FROM (SELECT src AS n FROM car_pair UNION SELECT dst FROM car_pair)), "
       f"best AS (SELECT a.id, arg_min(n.id, (round({NODE_OF}, 6), n.id)) AS node, min({NODE_OF}) AS d FROM addr a JOIN rnode n ON abs(a.lat - n.lat) < 0.2e0 AND abs(a.lon - n.lon) < 0.4e0 GROUP BY 1) "
       f"SELECT id AS address_id, round(lon, 6) AS address_lon, round(lat, 6) AS address_lat, city AS \"addr:city\", round(d, 3) AS distance_meters FROM addr JOIN best USING (id)")
def _(spark, sf):
    tagged = D.addresses(spark, sf).select("id", "lat", "lon", F.create_map(F.lit("addr:city"), F.col("city")).alias("tags"))
    out = EL.addresses_with_nodes(tagged, road_nodes(spark, sf))
    return out.select("address_id", F.round("address_lon", 6).alias("address_lon"), F.round("address_lat", 6).alias("address_lat"),
                      F.col("`addr:city`"), F.round("distance_meters", 3).alias("distance_meters"))


@query("element_counts", with_("refs way node", "SELECT 'node' AS kind, count(*) AS elements FROM node UNION ALL SELECT 'way', count(*) FROM way UNION ALL "
       "SELECT 'relation', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'total', (SELECT count(*) FROM node) + (SELECT count(*) FROM way) + (SELECT count(DISTINCT o_custkey) FROM orders)"))
def _(spark, sf):
    return EL.element_counts(D.osm(spark, sf))


@query("trim_network", with_("refs way node", "SELECT DISTINCT n.id, round(n.lat, 6) AS lat, round(n.lon, 6) AS lon FROM refs JOIN way w ON w.id = way_id JOIN node n ON n.id = node_id WHERE w.highway IS NOT NULL"))
def _(spark, sf):
    return EL.trim_network(D.osm(spark, sf)).nodes.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("trim_network_routable", with_("way route_way", "SELECT id FROM route_way"))
def _(spark, sf):
    return EL.trim_network(D.osm(spark, sf), routable_only=True).ways.select("id")


def _in_box(a: str) -> str:
    return (f"(CASE WHEN abs({a}.lat - (50e0 + 0.6e0 * floor(({a}.lat - 50e0) / 0.6e0) + 0.3e0)) < 0.1e0 "
            f"AND abs({a}.lon - (floor({a}.lon) + 0.5e0)) < 0.1e0 THEN NULL ELSE {box(a + '.lat', a + '.lon')} END)")


PLACES = (
    f"rn AS (SELECT n.*, {_in_box('n')} AS region FROM node n), "
    "np AS (SELECT id, CASE kind WHEN 0 THEN 'shop' WHEN 1 THEN 'restaurant' WHEN 2 THEN 'residential' ELSE 'office' END AS category, lat, lon, region, 1 AS is_node, 0 AS is_way, 0 AS is_relation FROM rn WHERE region IS NOT NULL), "
    "wc0 AS (SELECT way_id AS id, avg(lat) AS lat, avg(lon) AS lon FROM refs JOIN way w ON w.id = way_id JOIN rn ON rn.id = node_id WHERE region IS NOT NULL GROUP BY 1), "
    f"wc AS (SELECT c.*, {_in_box('c')} AS region FROM wc0 c), "
    "wp AS (SELECT w.id, CASE w.building WHEN 'house' THEN 'residential' ELSE 'warehouse' END AS category, lat, lon, region, 0, 1, 0 FROM way w JOIN wc USING (id) WHERE w.building IS NOT NULL AND region IS NOT NULL), "
    "rc AS (SELECT o_custkey AS id, avg(lat) AS lat, avg(lon) AS lon FROM orders JOIN wc ON wc.id = o_orderkey WHERE o_orderkey % 3 <> 0 AND region IS NOT NULL GROUP BY 1), "
    f"rp AS (SELECT id, 'residential' AS category, lat, lon, region, 0, 0, 1 FROM (SELECT c.*, {_in_box('c')} AS region FROM rc c) WHERE region IS NOT NULL), "
    "place AS (SELECT * FROM np UNION ALL SELECT * FROM wp UNION ALL SELECT * FROM rp) "
)


def places_sql(body: str) -> str:
    return with_("refs way node", "SELECT").removesuffix(" SELECT") + ", " + PLACES + body


def places(spark, sf):
    return EL.extract_places(D.osm(spark, sf), EL.category_rules(), RG.build_cover(D.regions(spark, sf)))


@query("extract_places", places_sql("SELECT id, category, round(lat, 6) AS lat, round(lon, 6) AS lon, region, is_node, is_way, is_relation FROM place"))
def _(spark, sf):
    return places(spark, sf).select("id", "category", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "region", "is_node", "is_way", "is_relation")


@query("sample_places", places_sql(
    f"SELECT id, category, region, is_node, is_way, is_relation FROM (SELECT *, row_number() OVER (PARTITION BY is_node, is_way, is_relation, category, region ORDER BY {hash01('id', 2)}, id) AS rn FROM place) WHERE rn <= 15"))
def _(spark, sf):
    rules = EL.category_rules([(n, t, 15) for n, t in EL.PLACE_CATEGORIES])
    s = EL.sample_places(places(spark, sf), rules, 2, "linear")
    return s.select("id", "category", "region", "is_node", "is_way", "is_relation")


@query("category_share", places_sql("SELECT category, count(*) AS places, round(avg(CAST(is_node AS DOUBLE)), 6) AS node_share, count(DISTINCT region) AS regions FROM place GROUP BY 1"))
def _(spark, sf):
    return RP.category_share(places(spark, sf)).withColumn("node_share", F.round("node_share", 6))


TAGGED = (
    "t AS (SELECT p_partkey AS id, p_type, p_brand, p_name, 'R' || lpad(CAST(p_size % 25 AS VARCHAR), 2, '0') AS region FROM part), "
    "tag AS (SELECT region, 'building=' || p_type AS tag FROM t UNION ALL SELECT region, 'shop=' || p_brand FROM t UNION ALL SELECT region, 'name' FROM t), "
    "cnt AS (SELECT tag, region, count(*) AS rows FROM tag GROUP BY 1, 2) "
)


def tagged_parts(spark, sf):
    p = D.table(spark, sf, "part")
    tags = D._tags(building=F.col("p_type"), shop=F.col("p_brand"), name=F.col("p_name"), addr__city=F.col("p_name"))
    region = F.concat(F.lit("R"), F.lpad((F.col("p_size") % 25).cast("string"), 2, "0"))
    return p.select(F.col("p_partkey").alias("id"), region.alias("region"), T.sorted_json(tags).alias("tags"))


@query("tag_counts", "WITH " + TAGGED + "SELECT tag, region, rows FROM cnt")
def _(spark, sf):
    return RP.tag_counts(tagged_parts(spark, sf))


@query("tag_frequency", "WITH " + TAGGED + "SELECT tag, count(*) AS rows FROM tag GROUP BY 1")
def _(spark, sf):
    return RP.tag_counts(tagged_parts(spark, sf), by_region=False)


@query("tag_totals", "WITH " + TAGGED + "SELECT tag, CAST(sum(rows) AS BIGINT) AS rows FROM cnt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return RP.tag_totals(RP.tag_counts(tagged_parts(spark, sf)))


@query("tag_coverage", "WITH " + TAGGED + "SELECT tag, count(*) FILTER (WHERE rows >= 3) AS regions, CAST(sum(rows) AS BIGINT) AS rows FROM cnt GROUP BY 1 "
       "HAVING count(*) FILTER (WHERE rows >= 3) = (SELECT count(DISTINCT region) FROM t)")
def _(spark, sf):
    return RP.tag_coverage(RP.tag_counts(tagged_parts(spark, sf)), 3)


MATRIX = [f"R{k:02d}" for k in range(25)]


@query("tag_matrix", "WITH " + TAGGED + "SELECT tag, " + ", ".join(f"CAST(coalesce(sum(rows) FILTER (WHERE region = '{r}'), 0) AS BIGINT) AS \"{r}\"" for r in MATRIX) + " FROM cnt GROUP BY 1")
def _(spark, sf):
    return RP.tag_matrix(RP.tag_counts(tagged_parts(spark, sf)), MATRIX)


# --- way rules -----------------------------------------------------------------

@query("routable_ways", with_("way route_way", "SELECT id, highway FROM route_way"))
def _(spark, sf):
    return WY.routable_ways(D.ways(spark, sf)).select("id", T.tag("tags", "highway").alias("highway"))


@query("routable_ways_legacy", with_("way", f"SELECT id FROM way WHERE highway IN {listed(T.ROUTABLE_HIGHWAYS + T.LEGACY_EXTRA_HIGHWAYS)}"))
def _(spark, sf):
    return WY.routable_ways(D.ways(spark, sf), "legacy").select("id")


@query("routable_ways_all", with_("way", "SELECT id FROM way WHERE highway IS NOT NULL"))
def _(spark, sf):
    return WY.routable_ways(D.ways(spark, sf), "all").select("id")


@query("speed_limits", with_("way", f"SELECT id, round({posted()}, 6) AS leading, round({posted('token')}, 6) AS token FROM way"))
def _(spark, sf):
    w = WY.with_speed_limit(WY.with_speed_limit(D.ways(spark, sf), "leading", "a"), "token", "b")
    return w.select("id", F.round("a", 6).alias("leading"), F.round("b", 6).alias("token"))


@query("profile_speed", with_("way", f"SELECT id, CAST({profile_kmh()} AS INTEGER) AS speed_kmh FROM way WHERE highway IS NOT NULL"))
def _(spark, sf):
    return WY.with_profile_speed(D.profile_ways(spark, sf)).select("id", "speed_kmh")


DIRECTION = "(CASE WHEN oneway = 'yes' THEN 'forward' WHEN oneway = '-1' THEN 'backward' WHEN highway IN ('motorway', 'motorway_link') THEN 'forward' ELSE 'both' END)"


@query("way_direction", with_("way", f"SELECT id, {DIRECTION} AS direction FROM way WHERE highway IS NOT NULL"))
def _(spark, sf):
    return WY.with_direction(D.profile_ways(spark, sf)).select("id", "direction")


# --- network reports -----------------------------------------------------------

@query("highway_types", with_("way", "SELECT highway, count(*) AS ways, round(count(*) * 100e0 / (SELECT count(*) FROM way WHERE highway IS NOT NULL), 6) AS percent FROM way WHERE highway IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return NW.highway_types(D.ways(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("highway_types_top", with_("way", "SELECT CASE WHEN rn <= 5 THEN highway ELSE '(other)' END AS highway, CAST(sum(n) AS BIGINT) AS ways, count(*) AS keys FROM "
       "(SELECT highway, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, highway) AS rn FROM way WHERE highway IS NOT NULL GROUP BY 1) GROUP BY 1"))
def _(spark, sf):
    return top_n_rest(NW.highway_types(D.ways(spark, sf)), "highway", "ways", 5)


@query("road_type_report", with_("way route_way", f", r AS (SELECT highway, {group_case('highway')} AS road_group FROM route_way) SELECT road_group, highway, count(*) AS ways, "
       "round(count(*) * 100e0 / (SELECT count(*) FROM r), 6) AS percent FROM r GROUP BY GROUPING SETS ((road_group, highway), (road_group))").replace(") , r", "), r"))
def _(spark, sf):
    return NW.road_type_report(D.ways(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("nodes_by_group", with_("refs way route_way", f", u AS (SELECT {group_case('highway')} AS road_group, node_id FROM route_way w JOIN refs ON w.id = way_id) "
       "SELECT road_group, count(DISTINCT node_id) AS nodes, count(*) AS node_refs, round(count(DISTINCT node_id) * 100e0 / (SELECT count(DISTINCT node_id) FROM u), 6) AS percent FROM u GROUP BY 1").replace(") , u", "), u"))
def _(spark, sf):
    return NW.nodes_by_group(D.ways(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("pruning_scenarios", with_("refs way route_way", f", u AS (SELECT node_id, min(list_position({[*T.HIGHWAY_GROUPS]!r}, {group_case('highway')})) AS r FROM route_way w JOIN refs ON w.id = way_id GROUP BY 1) "
       "SELECT s AS scenario, count(*) FILTER (WHERE coalesce(r, 9) <= k) AS nodes, round(count(*) FILTER (WHERE coalesce(r, 9) <= k) * 100e0 / count(*), 6) AS percent "
       "FROM u, (VALUES ('major', 1), ('major_minor', 2), ('major_minor_link', 3), ('all', 99)) v(s, k) GROUP BY 1").replace(") , u", "), u"))
def _(spark, sf):
    return NW.pruning_scenarios(D.ways(spark, sf)).withColumn("percent", F.round("percent", 6))


# Degrees count every reference of routable ways, located or not.
DEG = "deg AS (SELECT n, count(*) AS degree FROM (SELECT src AS n FROM road_pair UNION ALL SELECT dst FROM road_pair) GROUP BY 1) "


def deg_sql(body: str) -> str:
    return with_("refs way route_way pair road_pair", "SELECT").removesuffix(" SELECT") + ", " + DEG + body


@query("degree_distribution", deg_sql("SELECT CASE WHEN degree <= 20 THEN CAST(degree AS VARCHAR) ELSE '>20' END AS degree, count(*) AS nodes, round(count(*) * 100e0 / (SELECT count(*) FROM deg), 6) AS percent FROM deg GROUP BY 1"))
def _(spark, sf):
    return NW.degree_distribution(NW.ref_pairs(D.ways(spark, sf))).withColumn("percent", F.round("percent", 6))


@query("connectivity_stats", deg_sql("SELECT count(*) AS nodes, count(*) FILTER (WHERE degree = 1) AS degree_1, count(*) FILTER (WHERE degree = 2) AS degree_2, count(*) FILTER (WHERE degree = 3) AS degree_3, "
       "count(*) FILTER (WHERE degree >= 4) AS degree_4_plus, round(count(*) FILTER (WHERE degree = 2) * 100e0 / count(*), 6) AS merge_reduction_percent FROM deg"))
def _(spark, sf):
    return NW.connectivity_stats(NW.ref_pairs(D.ways(spark, sf))).withColumn("merge_reduction_percent", F.round("merge_reduction_percent", 6))


@query("build_edges", with_("refs way route_way pair road_pair edge", "SELECT src, dst, way_id, highway FROM edge"))
def _(spark, sf):
    return NW.build_edges(D.road_ways(spark, sf), D.nodes(spark, sf))


ARC = (
    f"arc AS (SELECT way_id, seq, s AS src, d AS dst, CAST(floor({hav(lat_of('src'), lon_of('src'), lat_of('dst'), lon_of('dst'))}) AS BIGINT) AS distance_m, speed_kmh, "
    "way_id || ':' || seq || ':' || back AS arc_id FROM "
    f"(SELECT *, {DIRECTION} AS dir, CAST({profile_kmh()} AS INTEGER) AS speed_kmh FROM car_pair WHERE src <> dst) p, LATERAL (SELECT 0 AS back, p.src AS s, p.dst AS d UNION ALL SELECT 1, p.dst, p.src) "
    "WHERE dir = 'both' OR (dir = 'forward' AND back = 0) OR (dir = 'backward' AND back = 1)) "
)


def arc_sql(body: str) -> str:
    return with_("refs way pair car_pair", "SELECT").removesuffix(" SELECT") + ", " + ARC + body


def arcs(spark, sf):
    return NW.build_arcs(D.profile_ways(spark, sf), D.nodes(spark, sf))


@query("build_arcs", arc_sql("SELECT arc_id, src, dst, way_id, distance_m, speed_kmh FROM arc"))
def _(spark, sf):
    return arcs(spark, sf)


@query("arc_stats", arc_sql(", t AS (SELECT CASE WHEN speed_kmh > 0 AND distance_m > 0 THEN least(distance_m * 3600 // (speed_kmh * 1000), 86400) * 1000 END AS ms FROM arc) "
       "SELECT count(*) AS arcs, min(ms) FILTER (WHERE ms > 0) AS min_ms, max(ms) FILTER (WHERE ms > 0) AS max_ms, count(*) FILTER (WHERE ms = 0) AS zero, count(*) FILTER (WHERE ms IS NULL) AS infinite FROM t").replace(") , t", "), t"))
def _(spark, sf):
    return NW.arc_stats(arcs(spark, sf))


# --- components ----------------------------------------------------------------

# Smallest reachable node: keys are updated in place until nothing improves.
COMP = (
    "link AS (SELECT src AS a, dst AS b FROM edge WHERE src <> dst UNION SELECT dst, src FROM edge WHERE src <> dst), "
    "comp(node_id, component) USING KEY (node_id) AS (SELECT DISTINCT n, n FROM (SELECT src AS n FROM edge UNION ALL SELECT dst FROM edge) UNION "
    "SELECT l.b, min(c.component) FROM comp c JOIN link l ON l.a = c.node_id JOIN recurring.comp r ON r.node_id = l.b WHERE c.component < r.component GROUP BY l.b) "
)


def comp_sql(body: str) -> str:
    return with_("refs way route_way pair road_pair car_pair edge node", "SELECT").removesuffix(" SELECT").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + COMP + body


def edges(spark, sf):
    return NW.build_edges(D.road_ways(spark, sf), D.nodes(spark, sf))


@query("connected_components", comp_sql("SELECT node_id, component FROM comp"))
def _(spark, sf):
    return NW.connected_components(edges(spark, sf))


@query("largest_component", comp_sql("SELECT node_id FROM comp WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"))
def _(spark, sf):
    return NW.largest_component(NW.connected_components(edges(spark, sf)))


REPORT = (
    "SELECT row_number() OVER (ORDER BY count(*) DESC, component DESC) AS rank, component, count(*) AS size, round(count(*) * 100e0 / (SELECT count(*) FROM comp), 6) AS percent, "
    "min(node_id) AS sample_node, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east "
    "FROM comp JOIN node ON node.id = node_id GROUP BY component"
)


@query("component_report", comp_sql(REPORT))
def _(spark, sf):
    r = NW.component_report(NW.connected_components(edges(spark, sf)), D.nodes(spark, sf))
    return r.select("rank", "component", "size", F.round("percent", 6).alias("percent"), "sample_node",
                    *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")])


@query("component_of_point", comp_sql(
    f", rep AS ({REPORT}), q AS (SELECT s_suppkey AS id, {lat_of('s_suppkey + 5000011')} AS lat, {lon_of('s_suppkey + 5000011')} AS lon FROM supplier), "
    "hit AS (SELECT q.id, n.id AS node_id, row_number() OVER (PARTITION BY q.id ORDER BY pow(q.lat - n.lat, 2) + pow(q.lon - n.lon, 2), n.id) AS rn FROM q, node n WHERE n.id IN (SELECT node_id FROM comp)) "
    "SELECT hit.id, hit.node_id, comp.component, rank, size FROM hit JOIN comp USING (node_id) JOIN rep USING (component) WHERE rn = 1").replace(") , rep", "), rep"))
def _(spark, sf):
    from ..operators.tiles import build_tile_index, nearest
    from ..scratch import cut
    comps = cut(NW.connected_components(edges(spark, sf)))
    on_road = D.nodes(spark, sf).join(comps.select(F.col("node_id").alias("id")), "id", "left_semi")
    ix = build_tile_index(on_road, "id", "lat", "lon", metric="degrees")
    q = D.employees(spark, sf).select(F.col("employee_id").alias("id"), "lat", "lon")
    asked = nearest(q, ix, "id", "lat", "lon").select("id", F.col("near_id").alias("node_id"))
    report = NW.component_report(comps, D.nodes(spark, sf))
    return NW.component_of(comps, report, asked).select("id", "node_id", "component", "rank", "size")


BIG = ("big AS (SELECT node_id FROM comp WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)), "
       "kept AS (SELECT DISTINCT way_id FROM refs JOIN way w ON w.id = way_id WHERE node_id IN (SELECT node_id FROM big)) ")


@query("trim_to_component", comp_sql(", " + BIG + "SELECT way_id AS id FROM kept").replace(") , big", "), big"))
def _(spark, sf):
    o = D.osm(spark, sf)
    return NW.trim_to_component(o, NW.largest_component(NW.connected_components(edges(spark, sf)))).ways.select("id")


@query("trim_stats", comp_sql(", " + BIG + ", s AS (SELECT 'node' AS kind, (SELECT count(*) FROM big) AS kept, (SELECT count(*) FROM node) AS total UNION ALL "
       "SELECT 'way', (SELECT count(*) FROM kept), (SELECT count(*) FROM way) UNION ALL SELECT 'relation', (SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT o_custkey) FROM orders)) "
       "SELECT kind, kept, total, round(kept * 100e0 / total, 6) AS percent FROM s").replace(") , big", "), big").replace(") , s AS", "), s AS"))
def _(spark, sf):
    from ..scratch import cut
    o = D.osm(spark, sf)
    big = cut(NW.largest_component(NW.connected_components(edges(spark, sf))))
    return NW.trim_stats(o, NW.trim_to_component(o, big)).withColumn("percent", F.round("percent", 6))


# --- simplification ------------------------------------------------------------

SIMPLE = (
    "sw AS (SELECT r.*, count(*) OVER (PARTITION BY way_id) AS n FROM refs r JOIN route_way w ON w.id = r.way_id), "
    "ends AS (SELECT DISTINCT node_id FROM sw WHERE n >= 2 AND (pos = 0 OR pos = n - 1)), "
    f"m AS (SELECT sw.*, {lat_of('node_id')} AS lat, {lon_of('node_id')} AS lon, (pos = 0 OR pos = n - 1 OR node_id IN (SELECT node_id FROM ends)) AS cand FROM sw WHERE n >= 2), "
    f"st AS (SELECT *, coalesce({hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step, "
    "last_value(CASE WHEN cand THEN node_id END IGNORE NULLS) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m WINDOW w AS (PARTITION BY way_id ORDER BY pos)), "
    "sy AS (SELECT *, cand AND (prev IS NULL OR prev <> node_id) AS stay FROM st), "
    "sg AS (SELECT *, coalesce(sum(CASE WHEN stay AND pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM sy), "
    "sl AS (SELECT way_id, seg, sum(step) AS m, max(CAST(stay AND pos > 0 AS INTEGER)) AS closed FROM sg GROUP BY 1, 2), "
    "simp AS (SELECT way_id AS id, list(node_id ORDER BY pos) FILTER (WHERE stay) AS refs, CAST(round_even(sum(step), 0) AS BIGINT) AS length_m, any_value(n) AS orig_nodes FROM sg GROUP BY 1 HAVING count(*) FILTER (WHERE stay) >= 2) "
)


@query("simplify_ways", with_("refs way route_way", "SELECT").removesuffix(" SELECT") + ", " + SIMPLE +
       f"SELECT s.id, array_to_string(refs, ';') AS refs, length_m, CAST(orig_nodes AS INTEGER) AS orig_nodes, CAST(len(refs) AS INTEGER) AS kept_nodes, "
       "(SELECT string_agg(CAST(CAST(round_even(m, 0) AS BIGINT) AS VARCHAR), ';' ORDER BY seg) FROM sl WHERE sl.way_id = s.id AND closed = 1) AS seg_length_m, "
       f"CASE WHEN {posted('token')} > 0 THEN CAST(round_even(length_m / 1000e0 / {posted('token')} * 3600e0, 0) AS BIGINT) END AS duration_s FROM simp s JOIN route_way USING (id)")
def _(spark, sf):
    s = NW.simplify_ways(D.ways(spark, sf), D.nodes(spark, sf))
    def text(c):
        return F.array_join(F.col(c).cast("array<string>"), ";")
    return s.select("id", text("refs").alias("refs"), "length_m", "orig_nodes", "kept_nodes", text("seg_length_m").alias("seg_length_m"), "duration_s")


@query("simplified_tags", with_("refs way route_way", "SELECT").removesuffix(" SELECT") + ", " + SIMPLE +
       "SELECT id, CAST(length_m AS VARCHAR) AS length_m, CAST(len(refs) AS VARCHAR) AS kept_nodes, highway FROM simp JOIN route_way USING (id)")
def _(spark, sf):
    s = NW.with_simplified_tags(NW.simplify_ways(D.ways(spark, sf), D.nodes(spark, sf)))
    return s.select("id", T.tag("tags", "length_m").alias("length_m"), T.tag("tags", "kept_nodes").alias("kept_nodes"), T.tag("tags", "highway").alias("highway"))


# --- routes --------------------------------------------------------------------

def trips(spark, sf):
    """One trip per supplier between two derived positions."""
    e = D.employees(spark, sf).select(F.col("employee_id").alias("request_id"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    return D.located(e, F.col("request_id") * 17 + 3, "to_lat", "to_lon")


TRIPS = (f"trip AS (SELECT s_suppkey AS request_id, {lat_of('s_suppkey + 5000011')} AS from_lat, {lon_of('s_suppkey + 5000011')} AS from_lon, "
         f"{lat_of('s_suppkey * 17 + 3')} AS to_lat, {lon_of('s_suppkey * 17 + 3')} AS to_lon FROM supplier), "
         "rnode AS (SELECT id, lat, lon FROM node WHERE id IN (SELECT src FROM car_pair UNION ALL SELECT dst FROM car_pair)) ")


def road_nodes(spark, sf):
    used = NW.way_pairs(D.profile_ways(spark, sf), D.nodes(spark, sf)).select(F.explode(F.array("src", "dst")).alias("id"))
    return D.nodes(spark, sf).join(used, "id", "left_semi")


def _snap_leg(end: str) -> str:
    d = hav(f"t.{end}_lat", f"t.{end}_lon", "n.lat", "n.lon")
    return (f"(SELECT * FROM (SELECT t.request_id, n.id AS node_id, {d} AS d, row_number() OVER (PARTITION BY t.request_id ORDER BY {d}, n.id) AS rn FROM trip t, rnode n "
            f"WHERE abs(t.{end}_lat - n.lat) < 0.2e0 AND abs(t.{end}_lon - n.lon) < 0.4e0) WHERE rn = 1 AND d <= 4000)")


@query("snap_trips", with_("refs way node pair car_pair", "SELECT").removesuffix(" SELECT") + ", " + TRIPS +
       f"SELECT request_id, a.node_id AS source, round(a.d, 3) AS start_walk_m, b.node_id AS target, round(b.d, 3) AS end_walk_m FROM trip LEFT JOIN {_snap_leg('from')} a USING (request_id) LEFT JOIN {_snap_leg('to')} b USING (request_id)")
def _(spark, sf):
    s = RT.snap(trips(spark, sf), road_nodes(spark, sf), 4000.0)
    return s.select("request_id", "source", F.round("start_walk_m", 3).alias("start_walk_m"), "target", F.round("end_walk_m", 3).alias("end_walk_m"))


def node_trips(spark, sf, comps):
    """From every component's smallest node to its largest one."""
    return comps.groupBy("component").agg(F.max("node_id").alias("target")).where("component <> target").select(
        F.col("component").alias("request_id"), F.col("component").alias("source"), "target"
    )


DIST = (
    "ask AS (SELECT component AS source, max(node_id) AS target FROM comp GROUP BY 1 HAVING component <> max(node_id)), "
    "sp(source, node_id, d) USING KEY (source, node_id) AS (SELECT source, source, CAST(0 AS BIGINT) FROM ask UNION "
    "SELECT s.source, a.dst, min(s.d + a.distance_m) FROM sp s JOIN arc a ON a.src = s.node_id LEFT JOIN recurring.sp o ON o.source = s.source AND o.node_id = a.dst "
    "WHERE o.d IS NULL OR s.d + a.distance_m < o.d GROUP BY 1, 2) "
)


@query("shortest_paths", comp_sql(", " + ARC + ", " + DIST + "SELECT a.source AS request_id, a.source, a.target, sp.d IS NOT NULL AS success, sp.d AS distance_m FROM ask a LEFT JOIN sp ON sp.source = a.source AND sp.node_id = a.target").replace(") , arc", "), arc").replace(") , ask", "), ask"))
def _(spark, sf):
    from ..scratch import cut
    comps = cut(NW.connected_components(edges(spark, sf)))
    return RT.shortest_paths(arcs(spark, sf), node_trips(spark, sf, comps), with_steps=False).routes


ROUTE_SQL = (
    "mt AS (SELECT way_id AS request_id, arg_min(node_id, pos) AS a, arg_max(node_id, pos) AS b FROM refs JOIN way w ON w.id = way_id WHERE w.highway IS NOT NULL GROUP BY 1 HAVING count(*) >= 2), "
    "one AS (SELECT src, dst, min(distance_m) AS m, arg_min(least(speed_kmh, 60), arc_id) AS kmh FROM arc GROUP BY 1, 2), "
    "sp(source, node_id, d, path) USING KEY (source, node_id) AS (SELECT DISTINCT a, a, CAST(0 AS BIGINT), [struct_pack(n := a, m := CAST(0 AS BIGINT), kmh := 0)] FROM mt UNION "
    "SELECT s.source, o.dst, min(s.d + o.m), arg_min(list_append(s.path, struct_pack(n := o.dst, m := o.m, kmh := o.kmh)), s.d + o.m) FROM sp s JOIN one o ON o.src = s.node_id "
    "LEFT JOIN recurring.sp k ON k.source = s.source AND k.node_id = o.dst WHERE k.d IS NULL OR s.d + o.m < k.d GROUP BY 1, 2), "
    f"leg AS (SELECT mt.*, {lat_of('a')} AS alat, {lon_of('a')} AS alon, {lat_of('b')} AS blat, {lon_of('b')} AS blon FROM mt), "
    f"leg2 AS (SELECT *, {hav('alat + 1e-5', 'alon', 'alat', 'alon')} AS wa, {hav('blat', 'blon + 1e-5', 'blat', 'blon')} AS wb FROM leg), "
    "pts AS (SELECT request_id, alat, alon, blat, blon, wa, wb, len(path) AS n, unnest(path) AS p, generate_subscripts(path, 1) AS i FROM leg2 JOIN sp ON sp.source = a AND sp.node_id = b), "
    "cum AS (SELECT *, floor(wa * 1000e0 / 1.67e0) + sum(CASE WHEN i > 1 THEN p.m * 3600000 // (p.kmh * 1000) ELSE 0 END) OVER w AS t, floor(wa) + sum(p.m) OVER w AS m FROM pts WINDOW w AS (PARTITION BY request_id ORDER BY i)) "
    f"SELECT request_id, CAST(i AS INTEGER) AS seq, {lat_of('p.n')} AS lat, {lon_of('p.n')} AS lon, CAST(t AS BIGINT) AS cum_time_ms, CAST(m AS BIGINT) AS cum_dist_m, "
    "CAST(CASE WHEN n = 1 OR i = 1 THEN 6 ELSE p.kmh END AS INTEGER) AS max_speed_kmh, false AS is_walking FROM cum UNION ALL "
    "SELECT request_id, 0, alat + 1e-5, alon, 0, 0, 6, true FROM cum WHERE i = 1 UNION ALL "
    "SELECT request_id, CAST(n + 1 AS INTEGER), blat, blon + 1e-5, CAST(t + floor(wb * 1000e0 / 1.67e0) AS BIGINT), CAST(m + floor(wb) AS BIGINT), 6, true FROM cum WHERE i = n"
)


@query("route_points", with_("refs way pair car_pair", "SELECT").removesuffix(" SELECT").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + ARC + ", " + ROUTE_SQL)
def _(spark, sf):
    from ..scratch import cut
    g, n = cut(arcs(spark, sf)), cut(road_nodes(spark, sf))
    legs = cut(RT.snap(trips_near_roads(spark, sf, n), n, 4000.0).withColumn("max_speed_kmh", F.lit(60)))
    p = RT.shortest_paths(g, legs)
    return RT.route_points(legs, p.steps, g, n)


def trips_near_roads(spark, sf, nodes):
    """A trip along every multi-node road way, starting and ending just off it."""
    w = D.profile_ways(spark, sf).where(F.size("refs") >= 2)
    ends = w.select(F.col("id").alias("request_id"), F.col("refs")[0].alias("a"), F.element_at("refs", -1).alias("b"))
    out = D.located(D.located(ends, "a", "from_lat", "from_lon"), "b", "to_lat", "to_lon")
    return out.select("request_id", (F.col("from_lat") + 1e-5).alias("from_lat"), "from_lon", "to_lat", (F.col("to_lon") + 1e-5).alias("to_lon"))


WAY_TRIPS = (
    "mt AS (SELECT way_id AS request_id, arg_min(node_id, pos) AS a, arg_max(node_id, pos) AS b FROM refs JOIN way w ON w.id = way_id WHERE w.highway IS NOT NULL GROUP BY 1 HAVING count(*) >= 2), "
    "one AS (SELECT src, dst, min(distance_m) AS distance_m, arg_min(distance_m * 3600000 // (least(speed_kmh, 60) * 1000), arc_id) AS ms FROM arc GROUP BY 1, 2), "
    "sp(source, node_id, d, ms, hops) USING KEY (source, node_id) AS (SELECT DISTINCT a, a, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM mt UNION "
    "SELECT s.source, o.dst, min(s.d + o.distance_m), arg_min(s.ms + o.ms, s.d + o.distance_m), arg_min(s.hops + 1, s.d + o.distance_m) FROM sp s JOIN one o ON o.src = s.node_id "
    "LEFT JOIN recurring.sp k ON k.source = s.source AND k.node_id = o.dst WHERE k.d IS NULL OR s.d + o.distance_m < k.d GROUP BY 1, 2), "
    f"leg AS (SELECT mt.*, {hav(lat_of('a') + ' + 1e-5', lon_of('a'), lat_of('a'), lon_of('a'))} AS wa, {hav(lat_of('b'), lon_of('b') + ' + 1e-5', lat_of('b'), lon_of('b'))} AS wb FROM mt) "
)


@query("travel_time", with_("refs way pair car_pair", "SELECT").removesuffix(" SELECT").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + ARC + ", " + WAY_TRIPS +
       "SELECT request_id, CAST(ms + floor(wa * 1000e0 / 1.67e0) + floor(wb * 1000e0 / 1.67e0) AS BIGINT) AS travel_ms, CAST(d + floor(wa + wb) AS BIGINT) AS distance_m, CAST(hops AS INTEGER) AS hops "
       "FROM leg JOIN sp ON sp.source = a AND sp.node_id = b")
def _(spark, sf):
    from ..scratch import cut
    g, n = cut(arcs(spark, sf)), cut(road_nodes(spark, sf))
    legs = cut(RT.snap(trips_near_roads(spark, sf, n), n, 4000.0).withColumn("max_speed_kmh", F.lit(60)))
    return RT.travel_time(legs, RT.shortest_paths(g, legs).steps, g)


def job_requests(spark, sf):
    """First node, second node, last node of every road way with three or more."""
    w = D.profile_ways(spark, sf).where(F.size("refs") >= 3)
    r = w.select(F.col("id").alias("request_id"), F.col("refs")[0].alias("a"), F.col("refs")[1].alias("b"), F.element_at("refs", -1).alias("c"),
                 F.lit(50).alias("max_speed_kmh"), F.lit(0.5).alias("multiplier"))
    for c, p in (("a", "from"), ("b", "via"), ("c", "to")):
        r = D.located(r, c, f"{p}_lat", f"{p}_lon")
    return r


# Of equal lengths the path with fewest arcs, then the quickest under 50 km/h.
JOB_LEGS = (
    "mt AS (SELECT way_id AS request_id, arg_min(node_id, pos) AS a, max(CASE WHEN pos = 1 THEN node_id END) AS b, arg_max(node_id, pos) AS c "
    "FROM refs JOIN way w ON w.id = way_id WHERE w.highway IS NOT NULL GROUP BY 1 HAVING count(*) >= 3), "
    "leg AS (SELECT request_id, a AS s, b AS t FROM mt UNION ALL SELECT request_id, b, c FROM mt), "
    "one AS (SELECT src, dst, min(struct_pack(m := distance_m, h := 1, ms := CASE WHEN speed_kmh > 0 THEN distance_m * 3600000 // (least(speed_kmh, 50) * 1000) ELSE 0 END)) AS l FROM arc GROUP BY 1, 2), "
    "sp(source, node_id, l) USING KEY (source, node_id) AS (SELECT DISTINCT s, s, struct_pack(m := CAST(0 AS BIGINT), h := 0, ms := CAST(0 AS BIGINT)) FROM leg UNION "
    "SELECT p.source, o.dst, min(struct_pack(m := p.l.m + o.l.m, h := p.l.h + o.l.h, ms := p.l.ms + o.l.ms)) FROM sp p JOIN one o ON o.src = p.node_id "
    "LEFT JOIN recurring.sp k ON k.source = p.source AND k.node_id = o.dst WHERE k.l IS NULL OR struct_pack(m := p.l.m + o.l.m, h := p.l.h + o.l.h, ms := p.l.ms + o.l.ms) < k.l GROUP BY 1, 2) "
)


@query("job_route_totals", with_("refs way pair car_pair", "SELECT").removesuffix(" SELECT").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + ARC + ", " + JOB_LEGS +
       "SELECT request_id, CAST(floor(sum(l.ms) * 0.5e0) AS BIGINT) AS travel_ms, CAST(sum(l.m) AS BIGINT) AS distance_m FROM leg JOIN sp ON source = s AND node_id = t GROUP BY 1 HAVING count(*) = 2")
def _(spark, sf):
    from ..scratch import cut
    g, n = cut(arcs(spark, sf)), cut(road_nodes(spark, sf))
    return JR.job_routes(job_requests(spark, sf), g, n, points=False, snap_m=4000.0).totals


@query("goal_paths", comp_sql(", " + ARC + ", " + DIST + "SELECT a.source AS request_id, a.source, a.target, sp.d IS NOT NULL AS success, sp.d AS distance_m FROM ask a LEFT JOIN sp ON sp.source = a.source AND sp.node_id = a.target").replace(") , arc", "), arc").replace(") , ask", "), ask"))
def _(spark, sf):
    from ..scratch import cut
    comps, g = cut(NW.connected_components(edges(spark, sf))), cut(arcs(spark, sf))
    asked = cut(node_trips(spark, sf, comps))
    ends = asked.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    roads = RB.build_road_blocks(g, road_nodes(spark, sf), ends)
    return RB.goal_paths(roads, asked).routes.select("request_id", "source", "target", "success", "distance_m")


@query("job_routes")
def _(spark, sf):
    from ..scratch import cut
    g, n = cut(arcs(spark, sf)), cut(road_nodes(spark, sf))
    return JR.job_routes(job_requests(spark, sf), g, n, snap_m=4000.0).points


@query("position_at_time", with_("poly", "SELECT").removesuffix(" SELECT") + ", q AS (SELECT o_orderkey AS route_id, floor(o_totalprice / 2500e0) AS at_s FROM orders), "
       "span AS (SELECT route_id, min(cum_time_s) AS t0, max(cum_time_s) AS t1, arg_min(lat, seq) AS flat, arg_min(lon, seq) AS flon, arg_max(lat, seq) AS llat, arg_max(lon, seq) AS llon FROM poly GROUP BY 1), "
       "seg AS (SELECT route_id, cum_time_s AS s0, lead(cum_time_s) OVER w AS s1, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM poly WINDOW w AS (PARTITION BY route_id ORDER BY seq)), "
       "x AS (SELECT q.*, span.*, s.*, (at_s - s0) / (s1 - s0) AS f, "
       + hav("lat1", "lon1", "lat2", "lon2", "1e0") + " AS arc, atan2(sin(radians(lon2) - radians(lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1))) AS b "
       "FROM q JOIN span ON span.route_id = q.route_id LEFT JOIN seg s ON s.route_id = q.route_id AND at_s > t0 AND at_s < t1 AND at_s > s0 AND at_s <= s1), "
       "y AS (SELECT *, asin(sin(radians(lat1)) * cos(arc * f) + cos(radians(lat1)) * sin(arc * f) * cos(b)) AS la FROM x) "
       "SELECT route_id, round(CASE WHEN s0 IS NULL AND at_s <= t0 THEN flat WHEN s0 IS NULL THEN llat WHEN at_s = s1 THEN lat2 ELSE degrees(la) END, 5) AS lat, "
       "round(CASE WHEN s0 IS NULL AND at_s <= t0 THEN flon WHEN s0 IS NULL THEN llon WHEN at_s = s1 THEN lon2 ELSE lon1 + degrees(atan2(sin(b) * sin(arc * f) * cos(radians(lat1)), cos(arc * f) - sin(radians(lat1)) * sin(la))) END, 5) AS lon FROM y")
def _(spark, sf):
    q = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("route_id"), F.floor(F.col("o_totalprice") / 2500.0).cast("double").alias("at_s"))
    known = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route_id"))
    p = RT.position_at(D.route_polyline(spark, sf), q.join(known, "route_id", "left_semi"), query="route_id")
    return p.select("route_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("cap_speed", with_("poly", "SELECT").removesuffix(" SELECT") + ", s AS (SELECT *, cum_time_s - coalesce(lag(cum_time_s) OVER w, 0) AS step FROM poly WINDOW w AS (PARTITION BY route_id ORDER BY seq)) "
       "SELECT route_id, CAST(seq AS INTEGER) AS seq, round(sum(CASE WHEN NOT is_walking AND max_speed_kmh > 50 THEN step * max_speed_kmh / 50e0 ELSE step END * 0.75e0) OVER (PARTITION BY route_id ORDER BY seq), 5) AS cum_time_s, "
       "CASE WHEN NOT is_walking AND max_speed_kmh > 50 THEN 50e0 ELSE max_speed_kmh END AS max_speed_kmh, cum_dist_m FROM s")
def _(spark, sf):
    c = RT.cap_speed(D.route_polyline(spark, sf), 50.0, 0.75)
    return c.select("route_id", "seq", F.round("cum_time_s", 5).alias("cum_time_s"), "max_speed_kmh", "cum_dist_m")


@query("concat_routes", with_("poly", "SELECT").removesuffix(" SELECT") + ", e AS (SELECT route_id, max(seq) + 1 AS n, max(cum_time_s) AS t, max(cum_dist_m) AS m FROM poly GROUP BY 1) "
       "SELECT route_id, CAST(seq AS INTEGER) AS seq, cum_time_s, cum_dist_m FROM poly UNION ALL SELECT route_id, CAST(seq + n AS INTEGER), cum_time_s + t, cum_dist_m + m FROM poly JOIN e USING (route_id)")
def _(spark, sf):
    p = D.route_polyline(spark, sf)
    return RT.concat_routes(p, p).select("route_id", "seq", "cum_time_s", "cum_dist_m")
