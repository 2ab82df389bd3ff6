import math

import numpy as np
import pandas as pd
import pytest
from helpers import haversine, inside
from pyspark.sql import functions as F

from terraloom.functions import geo
from terraloom.operators import annulus as AN
from terraloom.operators import grid as G
from terraloom.operators import ranking as RK
from terraloom.operators import regions as RG
from terraloom.operators import reports as RP
from terraloom.operators import sampling as SM
from terraloom.operators.tiles import build_tile_index, nearest
from terraloom.scratch import cut_with


def star(cx, cy, r, n, seed):
    g = np.random.default_rng(seed)
    th = np.linspace(0, 2 * np.pi, n, endpoint=False)
    rr = r * (0.4 + 0.6 * g.random(n))
    return list(zip((cx + rr * np.cos(th)).tolist(), (cy + rr * np.sin(th)).tolist()))


@pytest.fixture(scope="module")
def shapes(spark):
    a = [[star(100e3, 100e3, 80e3, 120, 1), star(100e3, 100e3, 15e3, 30, 2)], [star(300e3, 80e3, 30e3, 40, 3)]]
    b = [[[(150e3, 20e3), (260e3, 20e3), (260e3, 130e3), (150e3, 130e3)]]]
    rows = [(c, "AA", c, [[[{"x": x, "y": y} for x, y in r] for r in poly] for poly in p]) for c, p in (("A", a), ("B", b))]
    return {"A": a, "B": b}, spark.createDataFrame(rows, RG.REGION_SCHEMA)


@pytest.mark.parametrize("cell", [7e3, 60e3])
def test_regions_match_even_odd_rule(spark, shapes, cell):
    polygons, df = shapes
    g = np.random.default_rng(4)
    x, y = g.random(6000) * 350e3, g.random(6000) * 200e3
    pts = spark.createDataFrame(pd.DataFrame({"id": np.arange(6000), "x": x, "y": y})).select(
        "id", geo.lat_of_mercator("y").alias("lat"), geo.lon_of_mercator("x").alias("lon"))
    got = RG.assign_regions(pts, RG.build_cover(df, cell), multi=True).toPandas()
    for code, poly in polygons.items():
        assert set(got[got.region == code].id) == set(np.where(inside(poly, x, y))[0])
    one = RG.assign_regions(pts, RG.build_cover(df, cell)).groupBy("id").count()
    assert one.count() == 6000 and one.where("count > 1").isEmpty()


def test_border_points_and_overlap(spark):
    corner = lambda la, lo: F.struct(geo.mercator_x(lo).alias("x"), geo.mercator_y(la).alias("y"))
    ring = F.array(F.array(F.array(*[corner(la, lo) for la, lo in ((10.0, 10.0), (10.0, 11.0), (11.0, 11.0), (11.0, 10.0))])))
    df = spark.range(2).select(F.concat(F.lit("XX0"), "id").alias("code"), ring.alias("polygons"))
    cover = RG.build_cover(df)
    pts = spark.createDataFrame([(1, 10.5, 10.5), (2, 10.0, 10.0), (3, 10.5, 10.0), (4, 10.5, 20.0)], "id int, lat double, lon double")
    tag = {r.id: r.region for r in RG.assign_regions(pts, cover).collect()}
    assert tag[1] == tag[2] == tag[3] == "XX00" and tag[4] is None
    strict = {r.id: r.region for r in RG.assign_regions(pts, cover, predicate="within").collect()}
    assert strict[1] == "XX00" and strict[2] is None and strict[3] is None
    assert RG.assign_regions(pts.where("id = 1"), cover, multi=True).count() == 2
    with pytest.raises(ValueError):
        RG.points_in_region(pts, df, "ZZ")
    with pytest.raises(ValueError):
        RG.points_in_regions(pts, df, ["ZZ", "QQ"])
    with pytest.raises(ValueError):
        RG.points_in_polygon(pts, df)


def test_points_in_regions_can_hold_border_points(spark):
    corner = lambda la, lo: F.struct(geo.mercator_x(lo).alias("x"), geo.mercator_y(la).alias("y"))
    ring = F.array(F.array(F.array(*[corner(la, lo) for la, lo in ((10.0, 10.0), (10.0, 11.0), (11.0, 11.0), (11.0, 10.0))])))
    df = spark.range(1).select(F.lit("XX0").alias("code"), ring.alias("polygons"))
    pts = spark.createDataFrame([(1, 10.5, 10.5), (2, 10.0, 10.5), (3, 9.9, 10.5)], "id int, lat double, lon double")
    def ids(**kw):
        return {r.id for r in RG.points_in_regions(pts, df, ["XX0", "ZZ"], **kw)[0].collect()}
    assert ids() == {1} and ids(predicate="covers") == {1, 2}


def test_cells_shrink_when_crowded(spark):
    ring = [[[{"x": x, "y": y} for x, y in star(5e3, 5e3, 4e3, 400, 9)]]]
    df = spark.createDataFrame([("A", "A", "a", ring)], RG.REGION_SCHEMA)
    cover = RG.build_cover(df, 20e3, max_edges=20)
    assert cover.cell_m < 20e3 and len(cover.levels) > 2
    g = np.random.default_rng(6)
    x, y = g.random(800) * 10e3, g.random(800) * 10e3
    pts = spark.createDataFrame(pd.DataFrame({"id": np.arange(800), "x": x, "y": y})).select(
        "id", geo.lat_of_mercator("y").alias("lat"), geo.lon_of_mercator("x").alias("lon"))
    got = RG.assign_regions(pts, cover, how="inner")
    assert {r.id for r in got.collect()} == set(np.where(inside([[star(5e3, 5e3, 4e3, 400, 9)]], x, y))[0])
    from terraloom import scratch
    scratch.clear(spark)


@pytest.fixture(scope="module")
def cloud(spark):
    """Targets with a crowd in one spot and a third at one place."""
    g = np.random.default_rng(0)
    n = 3000
    t = pd.DataFrame({"id": np.arange(n), "lat": 50 + g.random(n) * 3, "lon": 3 + g.random(n) * 5})
    t.loc[:1000, "lat"] = 51.00005
    t.loc[:1000, "lon"] = 4.00005
    t.loc[1001:1600, "lat"] = 51 + g.random(600) * 1e-3
    t.loc[1001:1600, "lon"] = 4 + g.random(600) * 1e-3
    q = pd.DataFrame({"qid": np.arange(400), "qlat": 49.5 + g.random(400) * 4, "qlon": 2.5 + g.random(400) * 6})
    return t, q, spark.createDataFrame(t), spark.createDataFrame(q)


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_matches_brute_force(cloud, k):
    t, q, ts, qs = cloud
    d = haversine(q.qlat.values[:, None], q.qlon.values[:, None], t.lat.values[None], t.lon.values[None])
    ix = build_tile_index(ts, "id", "lat", "lon", k=k)
    got = nearest(qs, ix, "qid", "qlat", "qlon").toPandas().sort_values(["qid", "near_rank"])
    assert len(got) == 400 * k
    assert np.allclose(got.distance.values, np.sort(d, axis=1)[:, :k].ravel(), atol=1e-6)
    if k == 1:
        near = nearest(qs, ix, "qid", "qlat", "qlon", max_distance=5000.0).count()
        assert near == int((d.min(axis=1) <= 5000).sum())


def test_annulus_pairs_and_checks(cloud):
    t, q, ts, qs = cloud
    d = haversine(q.qlat.values[:, None], q.qlon.values[:, None], t.lat.values[None], t.lon.values[None])
    c = qs.select(F.col("qid").alias("center_id"), F.col("qlat").alias("clat"), F.col("qlon").alias("clon"))
    assert AN.annulus(ts, c, 5.0, 20.0).count() == int(((d >= 5000) & (d <= 20000)).sum())
    for lo, hi in ((-1, 1), (2, 1)):
        with pytest.raises(ValueError):
            AN.annulus(ts, c, lo, hi)


def test_annulus_runs_hold_all_pairs(spark, cloud):
    t, q, ts, qs = cloud
    d = haversine(q.qlat.values[:, None], q.qlon.values[:, None], t.lat.values[None], t.lon.values[None])
    c = qs.select(F.col("qid").alias("center_id"), F.col("qlat").alias("clat"), F.col("qlon").alias("clon"))
    order = AN.PointOrder(ts, *[x for x in ("tid", "id") if x in ts.columns][:1])
    runs = AN.annulus_runs(order, c, 5.0, 20.0)
    got = runs.withColumn("pos", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1))).select("center_id", "pos")
    assert got.count() == got.distinct().count() == int(((d >= 5000) & (d <= 20000)).sum())
    far = got.join(order.members(), "pos").join(c, "center_id").select(geo.haversine_m("clat", "clon", "plat", "plon").alias("m")).agg(F.min("m"), F.max("m")).first()
    assert far[0] >= 5000 and far[1] <= 20000


def test_crowds_are_few_runs_and_wrap(spark):
    """Tens of thousands of points in a band are few rows, over the date line too."""
    g = np.random.default_rng(8)
    p = pd.DataFrame({"id": np.arange(40_000), "lat": g.normal(10, 0.3, 40_000), "lon": (g.normal(180, 0.3, 40_000) + 180) % 360 - 180})
    order = AN.PointOrder(spark.createDataFrame(p))
    c = spark.createDataFrame([(1, 10.0, 179.95), (2, 10.0, -179.9), (3, -60.0, 0.0), (4, None, 1.0)], "center_id int, clat double, clon double")
    runs = AN.annulus_runs(order, c, 10.0, 60.0)
    got = {r.center_id: (r.n, r.rows) for r in runs.groupBy("center_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    for k, lon in ((1, 179.95), (2, -179.9)):
        d = haversine(10.0, lon, p.lat.values, p.lon.values)
        assert got[k][0] == int(((d >= 10_000) & (d <= 60_000)).sum()) and got[k][1] < got[k][0] / 4
    assert set(got) == {1, 2}
    req = c.where("center_id < 4").select(F.col("center_id").alias("request_id"), F.col("clat").alias("lat"), F.col("clon").alias("lon"), F.lit(1).alias("tier"))
    loose = AN.band_runs(order, AN._asked(req.select(F.col("request_id").alias("rid"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon"),
                         F.lit(10.0).alias("lo"), F.lit(60.0).alias("hi")), "circle"), "circle", AN.LOOSE)
    rows = {r.rid: r["count"] for r in loose.groupBy("rid").count().collect()}
    assert set(rows) == {1, 2} and max(rows.values()) < 400


def test_band_pick_is_whole_and_uniform(spark):
    """Every request with a point in its band gets one, crowd or not."""
    g = np.random.default_rng(5)
    n = 600
    p = pd.DataFrame({"id": np.arange(n), "lat": 50 + g.random(n), "lon": 5 + g.random(n)})
    p.loc[:250, ["lat", "lon"]] = [50.5, 5.5]
    pts = spark.createDataFrame(p)
    req = pts.select(F.col("id").alias("request_id"), "lat", "lon", (F.col("id") % 2 + 1).cast("int").alias("tier"))
    bands = {1: (2.0, 12.0), 2: (30.0, 60.0)}
    got = AN.pick_in_band(req, pts, bands, tries=2).toPandas().set_index("request_id")
    la, lo = p.lat.values, p.lon.values
    def east(lat, km):
        r, d = np.radians(lat), km / 6371.0088
        return np.degrees(np.arctan2(np.sin(d) * np.cos(r), np.cos(d) - np.sin(r) ** 2 * np.cos(d)))
    for i in range(n):
        a, b = bands[i % 2 + 1]
        dy, dx = np.abs(la - la[i]), np.abs(lo - lo[i])
        ok = (dy <= b / 111) & (dx <= east(la[i], b)) & ~((dy <= a / 111) & (dx <= east(la[i], a)))
        assert (i in got.index) == bool(ok.any())
        if ok.any():
            assert ok[int(got.loc[i, "picked_id"])]
    same = AN.pick_in_band(req.repartition(5), pts.repartition(3), bands, tries=2).toPandas().set_index("request_id")
    assert (same.picked_id.sort_index() == got.picked_id.sort_index()).all()


def test_band_joins_meet_few_candidates_and_write_little(spark, monkeypatch):
    rows = [(i, 50.0 + 3 * ((i * 7919) % 10007) / 10007, 3.0 + 5 * ((i * 104729) % 10009) / 10009) for i in range(3000)]
    pts = spark.createDataFrame(rows, "id long, lat double, lon double")
    c = pts.where("id < 40").select(F.col("id").alias("center_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    order = AN.PointOrder(pts)
    counts = {r[0]: r[1] for r in AN.annulus_counts(order, c, 20.0, 45.0).collect()}
    pairs = {r[0]: r[1] for r in AN.annulus(pts, c, 20.0, 45.0).groupBy("center_id").count().collect()}
    want = {r[0]: r[1] for r in pts.crossJoin(c).where(geo.haversine_m("clat", "clon", "lat", "lon").between(20000, 45000)).groupBy("center_id").count().collect()}
    assert counts == want and pairs == want
    # A walk writes no more than the cell and its run for each request.
    kept = []
    monkeypatch.setattr(AN, "cut_with", lambda df, **m: kept.append(df.columns) or cut_with(df, **m))
    req = c.select(F.col("center_id").alias("request_id"), F.col("clat").alias("lat"), F.col("clon").alias("lon"), F.lit(1).alias("tier"))
    assert AN.pick_in_band(req, order, {1: (20.0, 60.0)}, shape="circle", seed=5).count() == 40
    walked = [k for k in kept if "side" in k]
    assert walked and all(set(k) == {"rid", "lvl", "code", "start", "n", "leaf", "side"} for k in walked)


def test_pairs_meet_written_cubes(spark):
    """Centres spread over tasks; what finds the cubes is apart from what meets the points."""
    pts = spark.createDataFrame([(i, 50.0 + i / 100, 5.0) for i in range(50)], "id long, lat double, lon double").coalesce(1)
    c = pts.select(F.col("id").alias("center_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    pairs = AN.annulus(pts, c, 2.0, 9.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "LeftSemi" not in plan
    got = {(r.center_id, r.id, r.distance_m) for r in pairs.collect()}
    want = pts.crossJoin(c).withColumn("m", geo.haversine_m("clat", "clon", "lat", "lon")).where("m between 2000 and 9000")
    assert got == {(r.center_id, r.id, r.m) for r in want.collect()} and got


def test_walks_take_edges_from_the_cells(spark, monkeypatch):
    """No power of two is taken for a request and a cell, and draws collect no lists."""
    pts = spark.createDataFrame([(i, 50.0 + i % 40 / 40, 5.0 + i / 2000) for i in range(2000)], "id long, lat double, lon double")
    req = pts.where("id % 40 = 7").select(F.col("id").alias("request_id"), "lat", "lon", F.lit(1).alias("tier"))
    plans = []

    def kept(df, **m):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return cut_with(df, **m)

    monkeypatch.setattr(AN, "cut_with", kept)
    assert AN.pick_in_band(req, pts, {1: (5.0, 30.0)}).count() == 50
    opened = [p for c, p in plans if "side" in c][1:]
    assert opened and not any("POWER" in p for p in opened)
    drawn = [p for c, p in plans if "pid" in c and "plat" in c]
    assert drawn and not any("collect_list" in p for p in drawn)


def test_band_pick_counts(spark):
    """Picks from one centre spread evenly over the points in range."""
    pts = spark.createDataFrame([(i, 50.0 + 0.01 * i, 5.0) for i in range(20)], "id long, lat double, lon double")
    req = spark.range(4000).select(F.col("id").alias("request_id"), F.lit(50.0).alias("lat"), F.lit(5.0).alias("lon"), F.lit(1).alias("tier"))
    got = AN.pick_in_band(req, pts, {1: (1.5, 9.0)}, shape="circle").groupBy("picked_id").count().toPandas()
    assert set(got.picked_id) == {2, 3, 4, 5, 6, 7, 8}
    assert got["count"].sum() == 4000 and got["count"].min() > 450 and got["count"].max() < 700


def test_annulus_points_stay_in_range(spark):
    df = spark.range(500).withColumn("lat", F.lit(52.0)).withColumn("lon", F.lit(5.0)).withColumn("u", F.rand(1)).withColumn("v", F.rand(2))
    lat, lon = SM.annulus_point("lat", "lon", 1000.0, 2000.0, F.col("u"), F.col("v"))
    d = df.select(geo.haversine_m("lat", "lon", lat, lon).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert d[0] >= 990 and d[1] <= 2010


def test_positions_and_pages(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5))
    got = RK.dense_positions(df, [F.col("id").desc()], ["g"]).toPandas()
    for _, part in got.groupby("g"):
        assert list(part.sort_values("id", ascending=False).position) == list(range(len(part)))
    run = RK.running_sum(df, "id", [F.col("id")], ["g"]).toPandas()
    for _, part in run.groupby("g"):
        assert list(part.sort_values("id").running) == list(part.sort_values("id").id.cumsum())
    a, b = SM.sample_page(df, 50, 3, 10, 1), SM.sample_page(df.repartition(9), 50, 3, 10, 1)
    assert [r.id for r in a.collect()] == [r.id for r in b.collect()] and a.count() == 10
    top = RK.top_n_rest(spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "k string, v long"), "k", "v", 1).toPandas().set_index("k")
    assert top.loc["a", "v"] == 5 and top.loc["(other)", "v"] == 4


def test_samples(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1500, "big").otherwise("small").alias("region"))
    res = SM.reservoir(df, ["region"], 40, "id", 1)
    assert {r["region"]: r["count"] for r in res.groupBy("region").count().collect()} == {"big": 40, "small": 40}
    assert res.exceptAll(SM.reservoir(df.repartition(6), ["region"], 40, "id", 1)).isEmpty()
    per = SM.sample_per_region(df, cap=300, seed=1)
    n = {r["region"]: r["count"] for r in per.groupBy("region").count().collect()}
    assert 230 < n["big"] < 370 and 230 < n["small"] < 370
    assert SM.sample_per_region(df, cap=5000).count() == 2000
    assert SM.tier_cdf()[-1] == pytest.approx(1.0)


def test_grid_golden(spark):
    box = spark.createDataFrame([(52.12, 52.08, 5.15, 5.10)], "north double, south double, east double, west double")
    g = G.grid_of(box, 0.1)
    r = g.first()
    assert r.dlat == pytest.approx(0.0009, abs=1e-5) and r.dlon == pytest.approx(0.00146, abs=1e-5)
    p = spark.createDataFrame([(52.1199, 5.1001), (51.0, 5.1)], "lat double, lon double")
    cells = G.with_cell(p, g).collect()
    assert [(c.cell_x, c.cell_y) for c in cells] == [(0, 0)]
    corner = G.neighbors(spark.createDataFrame([(0, 0)], "cell_x long, cell_y long"), g)
    assert {(r.near_x, r.near_y) for r in corner.collect()} == {(0, 1), (1, 0), (1, 1)}
    b = G.cell_bounds(spark.createDataFrame([(0, 0)], "cell_x long, cell_y long"), g).first()
    assert b.cell_north == 52.12 and b.cell_west == 5.10 and b.valid
    with pytest.raises(ValueError):
        G.grid_of(box, 0)


def test_density_and_histogram(spark):
    df = spark.createDataFrame([(i,) for i in [1, 1, 1, 2, 2, 9]], "points long")
    s = G.density_stats(df).first()
    assert (s.min, s.max, s.median, s.total, s.occupied_cells) == (1, 9, 1.5, 16, 6)
    assert s.std == pytest.approx(np.std([1, 1, 1, 2, 2, 9]))
    h = G.histogram(df).orderBy("bin").collect()
    assert len(h) == 5 and sum(r.rows for r in h) == 6 and h[0].rows == 5
    assert G.histogram(spark.createDataFrame([(3,)] * 4, "points long")).first().rows == 4


def test_fine_ring_splits_its_own_cells_only(spark):
    """A coast of 4000 edges in 400 m does not make the whole map fine."""
    rings = [[{"x": x, "y": y} for x, y in star(0, 0, 1e5, 4, 1)]], [[{"x": x, "y": y} for x, y in star(150, 90, 200, 4000, 2)]]
    df = spark.createDataFrame([("A", "A", "a", [[rings[0][0]]]), ("B", "B", "b", [[rings[1][0]]])], RG.REGION_SCHEMA)
    cover = RG.build_cover(df)
    assert cover.rows < 2000
    g = np.random.default_rng(8)
    x, y = g.random(500) * 1000 - 400, g.random(500) * 1000 - 400
    pts = spark.createDataFrame(pd.DataFrame({"id": np.arange(500), "x": x, "y": y})).select(
        "id", geo.lat_of_mercator("y").alias("lat"), geo.lon_of_mercator("x").alias("lon"))
    got = {(r.id, r.region) for r in RG.assign_regions(pts, cover, how="inner", multi=True).collect()}
    want = {(i, "A") for i in np.where(inside([[star(0, 0, 1e5, 4, 1)]], x, y))[0]} | {(i, "B") for i in np.where(inside([[star(150, 90, 200, 4000, 2)]], x, y))[0]}
    assert got == want


def test_values_at_ranks_are_exact(spark, monkeypatch):
    """A hot group, ties, tiny groups, outliers and nulls; only the bracket is ranked."""
    g = np.random.default_rng(6)
    p = pd.DataFrame({"k": ["hot"] * 30_000 + ["ties"] * 3000 + ["two"] * 2 + ["one"], "v": np.concatenate([
        g.lognormal(0, 3, 30_000), g.integers(0, 3, 3000), [1.0, 5.0], [7.0]])})
    df = spark.createDataFrame(p).unionByName(spark.createDataFrame([("hot", None), ("none", None)], "k string, v double"))
    held = []
    monkeypatch.setattr(RP, "running_sum", lambda d, *a, old=RP.running_sum, **k: held.append(d.count()) or old(d, *a, **k))
    n = F.col("_n")
    ranks = {"low": F.floor((n + 1) / 2), "p95": F.greatest(F.ceil(n * 0.95), F.lit(1)), "top": n, "first": F.lit(1)}
    got = {r.k: r for r in RP.values_at_ranks(df, ["k"], "v", ranks).collect()}
    assert set(got) == {"hot", "ties", "two", "one"}
    for k, part in p.groupby("k"):
        v = np.sort(part.v.values)
        want = (v[(len(v) + 1) // 2 - 1], v[max(math.ceil(len(v) * 0.95), 1) - 1], v[-1], v[0])
        assert (got[k].low, got[k].p95, got[k].top, got[k].first) == want
    assert len(held) == 1 and held[0] < 4 * 30_000 / 20
    # A summary that lies about every step costs a second look, not the result.
    monkeypatch.setattr(RP.F, "percentile_approx", lambda *a: F.array_repeat(F.lit(-1.0), RP.SPLITS + 1))
    assert {r.k: r.low for r in RP.values_at_ranks(df, ["k"], "v", ranks).collect()} == {k: r.low for k, r in got.items()}


def test_snap_stats_median(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "distance double")
    assert RP.snap_stats(df).first().median_m == 2.0
    assert RP.snap_stats(df.limit(0)).first().median_m is None


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 7.0)], "k string, v double")
    got = {r.k: r.value for r in RP.nearest_rank(df, 0.95, ["k"], "v").collect()}
    assert got == {"a": 95.0, "b": 7.0}


def test_nearest_ranks_by_its_metric(spark):
    """Targets on a lattice: distances that tie or nearly so, as in SQL."""
    g = np.random.default_rng(5)
    n = np.arange(4000)
    t = pd.DataFrame({"id": n, "lat": 50 + 3 * (n * 7919 % 10007) / 10007, "lon": 3 + 5 * (n * 104729 % 10009) / 10009})
    # A crowd makes split tiles whose neighbours are leaves of the level above.
    t.loc[3000:, "lat"], t.loc[3000:, "lon"] = 51 + g.random(1000) * 1e-3, 4 + g.random(1000) * 1e-3
    m = 5000011 + np.arange(500)
    q = pd.DataFrame({"qid": np.arange(500), "qlat": 50 + 3 * (m * 7919 % 10007) / 10007, "qlon": 3 + 5 * (m * 104729 % 10009) / 10009})
    q.loc[400:449, "qlat"], q.loc[400:449, "qlon"] = 51 + g.random(50) * 1.2e-3, 4 + g.random(50) * 1.2e-3
    q.loc[450:, "qlat"], q.loc[450:, "qlon"] = 40 + g.random(50) * 45, g.random(50) * 359 - 179.5
    ts, qs = spark.createDataFrame(t), spark.createDataFrame(q)
    pairs = qs.crossJoin(ts).withColumn("d", geo.haversine_m("qlat", "qlon", "lat", "lon"))
    want = {r.qid: (r.b.d, r.b.id) for r in pairs.groupBy("qid").agg(F.min(F.struct("d", "id")).alias("b")).collect()}
    got = nearest(qs, build_tile_index(ts, "id", "lat", "lon"), "qid", "qlat", "qlon").collect()
    assert {r.qid: (r.distance, r.near_id) for r in got} == want
