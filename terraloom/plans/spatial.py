"""Queries over addresses, regions, grids, nearest joins and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import annulus as AN
from ..operators import grid as G
from ..operators import ranking as RK
from ..operators import regions as RG
from ..operators import reports as RP
from ..operators import sampling as SM
from ..operators.tiles import build_tile_index, nearest
from ..operators.routing import ADDRESS_RADIUS_M
from . import derive as D
from .oracle import box, hash01, hav, lat_of, lon_of, merc_x, merc_y, with_
from .registry import query

IN_BOX = (
    "(CASE WHEN abs(lat - (50e0 + 0.6e0 * floor((lat - 50e0) / 0.6e0) + 0.3e0)) < 0.1e0 "
    "AND abs(lon - (floor(lon) + 0.5e0)) < 0.1e0 THEN NULL ELSE " + box() + " END)"
)


def tagged(spark, sf, **kw):
    return RG.assign_regions(D.addresses(spark, sf), RG.build_cover(D.regions(spark, sf)), **kw)


@query("assign_regions", with_("addr", f"SELECT id, lat, lon, {IN_BOX} AS region FROM addr"))
def _(spark, sf):
    return tagged(spark, sf).select("id", "lat", "lon", "region")


@query("assign_regions_within", with_(
    "addr", f"SELECT id, {IN_BOX} AS region FROM addr WHERE {IN_BOX} IS NOT NULL AND lat > 50 AND lon > 3"))
def _(spark, sf):
    return tagged(spark, sf, predicate="within", multi=True, how="inner").select("id", "region")


@query("points_in_region", with_("addr", f"SELECT id, lat, lon FROM addr WHERE {IN_BOX} = 'R07'"))
def _(spark, sf):
    return RG.points_in_region(D.addresses(spark, sf), D.regions(spark, sf), "R07").select("id", "lat", "lon")


@query("points_in_regions", with_("addr", f"SELECT id, {IN_BOX} AS region FROM addr WHERE {IN_BOX} IN ('R03', 'R11', 'R24')"))
def _(spark, sf):
    # Points on a border count, as in the SQL.
    found, _ = RG.points_in_regions(D.addresses(spark, sf), D.regions(spark, sf), ["R03", "R11", "R24", "XX99"], predicate="covers")
    return found.select("id", "region")


@query("points_in_polygon", with_(
    "addr", "SELECT id, lat, lon FROM addr WHERE lat > 50.5e0 AND lat < 52.5e0 AND lon > 4 AND lon < 7 "
    "AND NOT (lat > 51 AND lat < 52 AND lon > 5 AND lon < 6)"))
def _(spark, sf):
    def ring(s, w, n, e):
        return F.array(*[F.struct(geo.mercator_x(lo).alias("x"), geo.mercator_y(la).alias("y"))
                         for la, lo in ((s, w), (s, e), (n, e), (n, w))])
    shape = spark.range(1).select(F.array(F.array(ring(50.5, 4.0, 52.5, 7.0), ring(51.0, 5.0, 52.0, 6.0))).alias("polygons"))
    return RG.points_in_polygon(D.addresses(spark, sf), shape).select("id", "lat", "lon")


@query("region_counts", with_("addr", f"SELECT {IN_BOX} AS region, count(*) AS address_count FROM addr WHERE {IN_BOX} IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return RP.region_counts(tagged(spark, sf))


@query("region_counts_top", with_(
    "addr", f"SELECT {IN_BOX} AS region, count(*) AS address_count FROM addr WHERE {IN_BOX} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(spark, sf):
    return RP.region_counts(tagged(spark, sf), top=10)


@query("region_dimension", "SELECT 'R' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, r_name AS country_code, n_name AS name_latn, "
       "(SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    c = D.table(spark, sf, "customer").groupBy(F.concat(F.lit("R"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("code")).agg(
        F.count(F.lit(1)).alias("customers"))
    return RG.region_dimension(D.regions(spark, sf)).join(c, "code", "left").withColumn("customers", F.coalesce("customers", F.lit(0)))


@query("regions_present", with_(
    "raddr", f"SELECT DISTINCT region AS code FROM raddr WHERE {IN_BOX} LIKE 'R1%'").replace("raddr AS (", f"addr AS (SELECT c_custkey AS id, {lat_of('c_custkey')} AS lat, {lon_of('c_custkey')} AS lon FROM customer), raddr AS (", 1))
def _(spark, sf):
    places = RP.places_in(tagged(spark, sf), "R1")
    return RP.regions_present(D.regions(spark, sf), places).select("code")


@query("mercator", with_("addr", f"SELECT id, round({merc_x('lon')}, 3) AS x, round({merc_y('lat')}, 3) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM addr"))
def _(spark, sf):
    a = D.addresses(spark, sf).select("id", geo.mercator_x("lon").alias("mx"), geo.mercator_y("lat").alias("my"))
    return a.select("id", F.round("mx", 3).alias("x"), F.round("my", 3).alias("y"),
                    F.round(geo.lat_of_mercator("my"), 6).alias("lat"), F.round(geo.lon_of_mercator("mx"), 6).alias("lon"))


@query("job_distances", with_(
    "job addr", f"SELECT job_id, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS meters, "
    f"round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon', '6371.0088e0')}, 6) AS km "
    "FROM job JOIN addr a ON a.id = start_address JOIN addr b ON b.id = end_address"))
def _(spark, sf):
    from ..operators.fleet import with_addresses
    j = with_addresses(D.jobs(spark, sf), D.addresses(spark, sf))
    return j.select("job_id", F.round(geo.haversine_m("start_lat", "start_lon", "end_lat", "end_lon"), 3).alias("meters"),
                    F.round(geo.great_circle_km("start_lat", "start_lon", "end_lat", "end_lon"), 6).alias("km"))


BBOX = "bb AS (SELECT max(lat) AS north, min(lat) AS south, max(lon) AS east, min(lon) AS west FROM addr)"
GRID = (
    BBOX + ", g AS (SELECT *, degrees({km}e0 / 6371.0088e0) AS dlat, "
    "abs(degrees(atan2(sin({km}e0 / 6371.0088e0) * cos(radians((north + south) / 2)), cos({km}e0 / 6371.0088e0) - sin(radians((north + south) / 2)) "
    "* sin(radians((north + south) / 2)) * cos({km}e0 / 6371.0088e0)))) AS dlon FROM bb), "
    "gg AS (SELECT *, CAST(ceil((east - west) / dlon) AS BIGINT) AS width, CAST(ceil((north - south) / dlat) AS BIGINT) AS height FROM g), "
    "cell AS (SELECT id, lat, lon, CAST(floor((lon - west) / dlon) AS BIGINT) AS cell_x, CAST(floor((north - lat) / dlat) AS BIGINT) AS cell_y FROM addr, gg), "
    "dens AS (SELECT cell_x, cell_y, count(*) AS points FROM cell GROUP BY 1, 2) "
)


def grid_sql(km: int, body: str) -> str:
    return with_("addr", "SELECT").removesuffix(" SELECT") + ", " + GRID.format(km=km) + body


def the_grid(spark, sf, km):
    return G.grid_of(G.bbox(D.addresses(spark, sf)), float(km))


@query("bbox", with_("addr", "SELECT max(lat) AS north, min(lat) AS south, max(lon) AS east, min(lon) AS west, count(*) AS points FROM addr"))
def _(spark, sf):
    return G.bbox(D.addresses(spark, sf))


@query("grid_cells", grid_sql(10, "SELECT id, cell_x, cell_y FROM cell"))
def _(spark, sf):
    return G.with_cell(D.addresses(spark, sf), the_grid(spark, sf, 10)).select("id", "cell_x", "cell_y")


@query("grid_dimensions", grid_sql(10, "SELECT round(dlat, 9) AS dlat, round(dlon, 9) AS dlon, width, height, width * height AS total_cells FROM gg"))
def _(spark, sf):
    return the_grid(spark, sf, 10).select(F.round("dlat", 9).alias("dlat"), F.round("dlon", 9).alias("dlon"), "width", "height", "total_cells")


@query("cell_density", grid_sql(20, "SELECT cell_x, cell_y, points, round((least(north - cell_y * dlat, north) + greatest(north - (cell_y + 1) * dlat, south)) / 2, 6) AS center_lat, "
       "round((least(west + (cell_x + 1) * dlon, east) + greatest(west + cell_x * dlon, west)) / 2, 6) AS center_lon FROM dens, gg"))
def _(spark, sf):
    d = G.cell_density(D.addresses(spark, sf), the_grid(spark, sf, 20))
    return d.select("cell_x", "cell_y", "points", F.round("center_lat", 6).alias("center_lat"), F.round("center_lon", 6).alias("center_lon"))


@query("cell_density_top", grid_sql(20, "SELECT cell_x, cell_y, points FROM dens ORDER BY points DESC, cell_x, cell_y LIMIT 10"))
def _(spark, sf):
    d = G.cell_density(D.addresses(spark, sf), the_grid(spark, sf, 20))
    return d.select("cell_x", "cell_y", "points").orderBy(F.desc("points"), "cell_x", "cell_y").limit(10)


@query("density_stats", grid_sql(20, "SELECT min(points) AS min, max(points) AS max, round(avg(points), 6) AS mean, median(points) AS median, round(stddev_pop(points), 6) AS std, "
       "CAST(sum(points) AS BIGINT) AS total, count(*) AS occupied_cells, max(width * height) AS total_cells FROM dens, gg"))
def _(spark, sf):
    g = the_grid(spark, sf, 20)
    s = G.density_stats(G.cell_density(D.addresses(spark, sf), g), g)
    return s.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("density_histogram", grid_sql(20, ", s AS (SELECT min(points) AS lo, max(points) AS hi, least(greatest(floor(sqrt(count(*))), 5), 20) AS bins FROM dens), "
       "t AS (SELECT lo, hi, CASE WHEN hi = lo THEN 1 ELSE CAST(bins AS BIGINT) END AS bins, CAST(ceil((hi - lo) / bins) AS BIGINT) AS width FROM s), "
       "b AS (SELECT CASE WHEN width = 0 THEN 0 ELSE least((points - lo) // greatest(width, 1), bins - 1) END AS bin, count(*) AS rows FROM dens, t GROUP BY 1) "
       "SELECT CAST(r.bin AS BIGINT) AS bin, lo + r.bin * width AS \"from\", CASE WHEN r.bin = bins - 1 THEN hi ELSE lo + (r.bin + 1) * width - 1 END AS \"to\", coalesce(b.rows, 0) AS rows "
       "FROM t, (SELECT unnest(range(20)) AS bin) r LEFT JOIN b ON b.bin = r.bin WHERE r.bin < bins").replace(" , s AS", ", s AS").replace("GROUP BY 1, 2) ,", "GROUP BY 1, 2),"))
def _(spark, sf):
    return G.histogram(G.cell_density(D.addresses(spark, sf), the_grid(spark, sf, 20)))


@query("cell_neighbors", grid_sql(30, "SELECT cell_x, cell_y, cell_x + dx AS near_x, cell_y + dy AS near_y FROM dens, gg, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) "
       "WHERE NOT (dx = 0 AND dy = 0) AND cell_x + dx BETWEEN 0 AND width - 1 AND cell_y + dy BETWEEN 0 AND height - 1"))
def _(spark, sf):
    g = the_grid(spark, sf, 30)
    return G.neighbors(G.cell_density(D.addresses(spark, sf), g), g)


@query("cells_in_bbox", grid_sql(15, ", q AS (SELECT id, least(lat + 0.15e0, north) AS n, greatest(lat - 0.15e0, south) AS s, least(lon + 0.2e0, east) AS e, greatest(lon - 0.2e0, west) AS w FROM addr, gg), "
       "r AS (SELECT id, CAST(floor((w - west) / dlon) AS BIGINT) AS x0, least(CAST(floor((e - west) / dlon) AS BIGINT), width - 1) AS x1, "
       "CAST(floor((north - n) / dlat) AS BIGINT) AS y0, least(CAST(floor((north - s) / dlat) AS BIGINT), height - 1) AS y1 FROM q, gg WHERE n > s AND e > w) "
       "SELECT x AS cell_x, y AS cell_y, count(*) AS boxes FROM (SELECT unnest(range(x0, x1 + 1)) AS x, y0, y1, id FROM r) t, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) GROUP BY 1, 2"
       ).replace("GROUP BY 1, 2) ,", "GROUP BY 1, 2),"))
def _(spark, sf):
    b = D.addresses(spark, sf).select((F.col("lat") + 0.15).alias("b_north"), (F.col("lat") - 0.15).alias("b_south"),
                                      (F.col("lon") + 0.2).alias("b_east"), (F.col("lon") - 0.2).alias("b_west"))
    return G.cells_in_bbox(b, the_grid(spark, sf, 15)).groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("boxes"))


@query("map_tiles", with_("addr", f"SELECT CAST(floor(({merc_x('lon')} + pi() * 6378137e0) / (2 * pi() * 6378137e0) * 1024) AS BIGINT) AS tile_x, "
       f"CAST(floor((pi() * 6378137e0 - {merc_y('lat')}) / (2 * pi() * 6378137e0) * 1024) AS BIGINT) AS tile_y, count(*) AS points FROM addr GROUP BY 1, 2"))
def _(spark, sf):
    return G.with_tile(D.addresses(spark, sf), 10).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("points"))


@query("square_annulus", with_("addr", "SELECT id FROM addr WHERE abs(lat - 51.5e0) <= 100e0 / 111e0 AND abs(lon - 5.5e0) <= {o} AND NOT (abs(lat - 51.5e0) <= 40e0 / 111e0 AND abs(lon - 5.5e0) <= {i})".format(
    **{n: f"degrees(atan2(sin({km}e0 / 6371.0088e0) * cos(radians(51.5e0)), cos({km}e0 / 6371.0088e0) * (1 - pow(sin(radians(51.5e0)), 2))))" for n, km in (("o", 100), ("i", 40))})))
def _(spark, sf):
    return AN.square_annulus(D.addresses(spark, sf), 51.5, 5.5, 40.0, 100.0).select("id")


# --- nearest joins -------------------------------------------------------------

NEAR = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS rn FROM (SELECT q.id AS qid, t.id AS tid, {dist} AS d, {m} AS m FROM {q} q, {t} t)) WHERE rn <= {k}"
HV = hav("q.lat", "q.lon", "t.lat", "t.lon")
EMP_POINTS = f"pt AS (SELECT s_suppkey AS id, {lat_of('s_suppkey + 5000011')} AS lat, {lon_of('s_suppkey + 5000011')} AS lon FROM supplier)"


def near_sql(body: str) -> str:
    return with_("addr", "SELECT").removesuffix(" SELECT") + ", " + EMP_POINTS + " " + body


def depots(spark, sf):
    return D.employees(spark, sf).select(F.col("employee_id").alias("id"), "lat", "lon")


@query("nearest_depot", near_sql(NEAR.format(cols="qid AS id, tid AS near_id, round(d, 3) AS meters", dist=HV, m="0", q="addr", t="pt", k=1)))
def _(spark, sf):
    ix = build_tile_index(depots(spark, sf), "id", "lat", "lon")
    return nearest(D.addresses(spark, sf), ix, "id", "lat", "lon").select("id", "near_id", F.round("distance", 3).alias("meters"))


@query("nearest_depot_degrees", near_sql(NEAR.format(
    cols="qid AS id, tid AS near_id, round(m, 3) AS meters", dist="pow(q.lat - t.lat, 2) + pow(q.lon - t.lon, 2)", m=HV, q="addr", t="pt", k=1)))
def _(spark, sf):
    ix = build_tile_index(depots(spark, sf), "id", "lat", "lon", metric="degrees")
    return nearest(D.addresses(spark, sf), ix, "id", "lat", "lon").select("id", "near_id", F.round("distance", 3).alias("meters"))


@query("nearest_address_in_range", near_sql(NEAR.format(
    cols="qid AS id, tid AS near_id, round(d, 3) AS meters", dist=HV, m="0", q="pt", t="addr", k=1) + " AND d <= 5000"))
def _(spark, sf):
    ix = build_tile_index(D.addresses(spark, sf), "id", "lat", "lon")
    hits = nearest(depots(spark, sf), ix, "id", "lat", "lon", max_distance=ADDRESS_RADIUS_M)
    return hits.select("id", "near_id", F.round("distance", 3).alias("meters"))


@query("three_nearest_depots", near_sql(NEAR.format(cols="qid AS id, CAST(rn AS INTEGER) AS rank, tid AS near_id, round(d, 3) AS meters", dist=HV, m="0", q="addr", t="pt", k=3)))
def _(spark, sf):
    ix = build_tile_index(depots(spark, sf), "id", "lat", "lon", k=3)
    hits = nearest(D.addresses(spark, sf), ix, "id", "lat", "lon")
    return hits.select("id", F.col("near_rank").alias("rank"), "near_id", F.round("distance", 3).alias("meters"))


@query("snap_stats", near_sql("SELECT count(*) AS pairs, round(avg(m), 3) AS avg_m, round(median(m), 3) AS median_m, round(max(m), 3) AS max_m FROM ("
       + NEAR.format(cols="m", dist="pow(q.lat - t.lat, 2) + pow(q.lon - t.lon, 2)", m=HV, q="addr", t="pt", k=1) + ")"))
def _(spark, sf):
    ix = build_tile_index(depots(spark, sf), "id", "lat", "lon", metric="degrees")
    s = RP.snap_stats(nearest(D.addresses(spark, sf), ix, "id", "lat", "lon"))
    return s.select("pairs", *[F.round(c, 3).alias(c) for c in ("avg_m", "median_m", "max_m")])


@query("annulus_pairs", near_sql(f"SELECT q.id AS center_id, t.id AS id, round({HV}, 3) AS meters FROM pt q, addr t WHERE {HV} BETWEEN 20000 AND 45000"))
def _(spark, sf):
    c = depots(spark, sf).select(F.col("id").alias("center_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    pairs = AN.annulus(D.addresses(spark, sf), c, 20.0, 45.0)
    # Rounded in doubles: F.round goes through decimal text, which costs a pair more than its distance.
    return pairs.select("center_id", "id", (F.floor(F.col("distance_m") * 1000 + 0.5) / 1000).alias("meters"))


@query("annulus_counts", near_sql(f"SELECT q.id AS center_id, count(*) AS points FROM pt q, addr t WHERE {HV} BETWEEN 20000 AND 45000 GROUP BY 1"))
def _(spark, sf):
    c = depots(spark, sf).select(F.col("id").alias("center_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    return AN.annulus_counts(D.addresses(spark, sf), c, 20.0, 45.0)


# --- samples -------------------------------------------------------------------

@query("sample_per_region", with_(
    "addr raddr", f"SELECT r.id, r.region FROM raddr r JOIN (SELECT region, least(1e0, 20e0 / count(*)) AS p FROM raddr GROUP BY 1) USING (region) "
    f"WHERE r.region NOT IN ('R04', 'R09') AND {hash01('r.id', 42)} < p"))
def _(spark, sf):
    return SM.sample_per_region(D.region_addresses(spark, sf), cap=20, seed=42, exclude=["R04", "R09"], method="linear").select("id", "region")


@query("reservoir_per_region", with_(
    "addr raddr", f"SELECT id, region FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {hash01('id', 7)}, id) AS rn FROM raddr) WHERE rn <= 12"))
def _(spark, sf):
    return SM.reservoir(D.region_addresses(spark, sf), ["region"], 12, "id", 7, "linear").select("id", "region")


@query("sample_page", with_(
    "addr", f"SELECT id, city FROM (SELECT * FROM addr ORDER BY {hash01('id', 5)}, id LIMIT 100) ORDER BY id LIMIT 25 OFFSET 25"))
def _(spark, sf):
    return SM.sample_page(D.addresses(spark, sf), 100, 5, 25, 1, method="linear").select("id", "city")


CDF = "[" + ", ".join(repr(x) + "e0" for x in SM.tier_cdf()[:-1]) + "]"
TIER = "CAST(len(list_filter(" + CDF + ", lambda c: c < {p})) + 1 AS INTEGER)"


@query("draw_tier", f"SELECT o_orderkey AS id, {TIER.format(p=hash01('o_orderkey', 3))} AS tier FROM orders")
def _(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return SM.draw_tier(o, "id", seed=3, method="linear")


@query("tier_weights", f"SELECT tier, count(*) AS rows, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS share, round(any_value(c), 6) AS cumulative FROM "
       f"(SELECT *, ([{', '.join(repr(x) + 'e0' for x in SM.tier_cdf())}])[tier] AS c FROM (SELECT {TIER.format(p=hash01('o_orderkey', 3))} AS tier FROM orders)) GROUP BY 1")
def _(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    w = SM.tier_weights(SM.draw_tier(o, "id", seed=3, method="linear"))
    return w.select("tier", "rows", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


MINS = "[" + ", ".join(str(m) for m in SM.CATEGORY_MIN_TIER.values()) + "]"


@query("draw_category", with_("job", f"SELECT job_id, tier, CAST(floor({hash01('job_id', 9)} * len(list_filter({MINS}, lambda m: m <= tier))) AS INTEGER) AS category FROM job"))
def _(spark, sf):
    return SM.draw_category(D.jobs(spark, sf).select("job_id", "tier"), "job_id", seed=9, method="linear")


@query("pick_one", f"SELECT o.o_orderkey AS request_id, a.c_custkey AS id FROM orders o JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) a "
       f"ON a.pos = CAST(floor({hash01('o.o_orderkey', 4)} * (SELECT count(*) FROM customer)) AS BIGINT)")
def _(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"))
    a = D.addresses(spark, sf).select("id")
    return RK.pick_one(a, o, "id", "request_id", D.lcg, 4).select("request_id", "id")


BANDS = {1: (10.0, 40.0), 2: (25.0, 60.0), 3: (40.0, 150.0)}


@query("pick_in_square_annulus")
def _(spark, sf):
    r = D.addresses(spark, sf).select(F.col("id").alias("request_id"), "lat", "lon", (F.col("id") % 3 + 1).cast("int").alias("tier"))
    return AN.pick_in_band(r, D.addresses(spark, sf), BANDS, method="linear", seed=11)


@query("pick_in_square_annulus_found", with_("addr", f"SELECT id AS request_id FROM addr a WHERE EXISTS (SELECT 1 FROM addr b WHERE abs(a.lat - b.lat) <= o / 111e0 AND abs(a.lon - b.lon) <= oe "
       "AND NOT (abs(a.lat - b.lat) <= i / 111e0 AND abs(a.lon - b.lon) <= ie))").replace("FROM addr a WHERE", "FROM (SELECT *, {o} AS oe, {i} AS ie FROM (SELECT *, [10e0, 25e0, 40e0][CAST(id % 3 AS INTEGER) + 1] AS i, [40e0, 60e0, 150e0][CAST(id % 3 AS INTEGER) + 1] AS o FROM addr)) a WHERE".format(
           **{n: f"degrees(atan2(sin({n} / 6371.0088e0) * cos(radians(lat)), cos({n} / 6371.0088e0) * (1 - pow(sin(radians(lat)), 2))))" for n in ("o", "i")})))
def _(spark, sf):
    r = D.addresses(spark, sf).select(F.col("id").alias("request_id"), "lat", "lon", (F.col("id") % 3 + 1).cast("int").alias("tier"))
    return AN.pick_in_band(r, D.addresses(spark, sf), BANDS, seed=12).select("request_id")


@query("pick_in_annulus")
def _(spark, sf):
    r = depots(spark, sf).select(F.col("id").alias("request_id"), "lat", "lon", F.lit(1).alias("tier"))
    return AN.pick_in_band(r, D.addresses(spark, sf), {1: (20.0, 60.0)}, shape="circle", seed=3)


@query("pick_in_annulus_checked", with_("emp addr", f"SELECT DISTINCT e.employee_id AS request_id, true AS in_band FROM emp e JOIN addr b ON {hav('e.lat', 'e.lon', 'b.lat', 'b.lon')} BETWEEN 20000 AND 60000"))
def _(spark, sf):
    """Every request with a point in its band gets one, and it lies there."""
    r = depots(spark, sf).select(F.col("id").alias("request_id"), "lat", "lon", F.lit(1).alias("tier"))
    p = AN.pick_in_band(r, D.addresses(spark, sf), {1: (20.0, 60.0)}, shape="circle", seed=3).select("request_id", "picked_id")
    spots = D.addresses(spark, sf).select(F.col("id").alias("picked_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    met = p.join(r, "request_id").join(spots, "picked_id")
    return met.select("request_id", geo.haversine_m("lat", "lon", "p_lat", "p_lon").between(20000, 60000).alias("in_band"))


RD_LAT = "c.lat + sqrt(5e3 * 5e3 + {v} * (2e4 * 2e4 - 5e3 * 5e3)) * sin({u} * 2 * pi()) / 111111e0"
RD_LON = "c.lon + sqrt(5e3 * 5e3 + {v} * (2e4 * 2e4 - 5e3 * 5e3)) * cos({u} * 2 * pi()) / (cos(radians(c.lat)) * 111111e0)"
_UV = {"u": hash01("c.id", "6 + t * 2"), "v": hash01("c.id", "6 + t * 2 + 1")}


@query("random_destination", near_sql(
    f", tries AS (SELECT c.id AS center_id, t, {RD_LAT.format(**_UV)} AS lat, {RD_LON.format(**_UV)} AS lon FROM pt c, (SELECT unnest(range(5)) AS t)), "
    f"hit AS (SELECT center_id, q.t AS attempt, a.id AS address_id, {hav('q.lat', 'q.lon', 'a.lat', 'a.lon')} AS d FROM tries q, addr a), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY attempt, d, address_id) AS rn FROM hit WHERE d <= 30000) "
    "SELECT center_id, address_id, CAST(attempt AS INTEGER) AS attempt FROM best WHERE rn = 1").replace(" , tries", ", tries"))
def _(spark, sf):
    c = depots(spark, sf).withColumnRenamed("id", "center_id")
    return AN.random_destination(c, D.addresses(spark, sf), 5000.0, 20000.0, seed=6, method="linear")
