"""Block routes against Dijkstra on (metres, hops, ms) and a router that makes detours."""

import heapq
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import generation as GN
from terraloom.operators import jobroutes as JR
from terraloom.operators import roadblocks as RB


def least(arcs, source, limit):
    near, out, todo = {}, {}, [((0, 0, 0), source)]
    for _, a, b, m, kmh in arcs:
        k = min(kmh, limit) if limit else kmh
        near.setdefault(a, []).append((b, (m, 1, m * 3600000 // (k * 1000) if k > 0 else 0)))
    while todo:
        label, n = heapq.heappop(todo)
        if n not in out:
            out[n] = label
            for b, w in near.get(n, []):
                heapq.heappush(todo, (tuple(x + y for x, y in zip(label, w, strict=True)), b))
    return out


@pytest.fixture(scope="module")
def graph(spark):
    """Random one-way arcs, equal lengths and speeds of 0 among them, a long chain, a ring and an island."""
    g = np.random.default_rng(3)
    arcs = [(f"a{i}", int(a), int(b), int(m), int(v)) for i, (a, b, m, v) in enumerate(
        zip(g.integers(0, 60, 110), g.integers(0, 60, 110), g.integers(0, 9, 110), g.choice([0, 5, 30], 110), strict=True))]
    for i in range(1000, 1030):
        arcs += [(f"c{i}", i, i + 1, 3, 20), (f"d{i}", i + 1, i, 4, 20)]
    arcs += [("x", 5, 1000, 1, 5), ("y", 1030, 7, 2, 5), ("z", 1000, 5, 1, 5)]
    arcs += [(f"r{i}", 2000 + i, 2000 + (i + 1) % 5, 1, 9) for i in range(5)] + [("s", 3000, 3001, 7, 10)]
    ids = sorted({n for _, a, b, *_ in arcs for n in (a, b)} | set(range(60)))
    nodes = [(n, None if n == 11 else 50.0 + (n * 37 % 101) / 500, 3.0 + (n * 61 % 97) / 500) for n in ids]
    asked = [(i, int(a), int(b), int(v) if v else None) for i, (a, b, v) in enumerate(
        zip(g.integers(0, 60, 25), g.integers(0, 60, 25), g.choice([0, 10], 25), strict=True))]
    asked += [(90, 5, 5, None), (91, 5, 99999, None), (92, 1004, 1020, None), (93, 1020, 1004, 7), (94, None, 3, None), (95, 3000, 3001, None),
              (96, 3001, 3000, None), (97, 2001, 2004, 5), (98, 5, 3000, None), (99, 1004, 1020, None)]
    return (arcs, spark.createDataFrame(arcs, "arc_id string, src long, dst long, distance_m long, speed_kmh int"),
            spark.createDataFrame(nodes, "id long, lat double, lon double"), asked,
            spark.createDataFrame(asked, "request_id long, source long, target long, max_speed_kmh int"))


@pytest.mark.parametrize("contracted", [True, False])
def test_goal_paths_match_dijkstra(spark, graph, contracted):
    arcs, a, nodes, asked, requests = graph
    keep = requests.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null").distinct() if contracted else None
    roads = RB.build_road_blocks(a, nodes, keep, per_block=40 if contracted else 90, landmarks=2)
    if contracted:
        assert roads.places.where("node between 1005 and 1019").count() == 0 and roads.chains.where("src = 1010").count() == 2
    p = RB.goal_paths(roads, requests, with_steps=True)
    got, steps, arc = {r.request_id: r for r in p.routes.collect()}, {}, {x[0]: x for x in arcs}
    for r in p.steps.orderBy("request_id", "seq").collect():
        steps.setdefault(r.request_id, []).append(r)
    for rid, s, t, limit in asked:
        want = None if s is None else (0, 0, 0) if s == t else least(arcs, s, limit).get(t)
        r = got[rid]
        assert ((r.distance_m, r.hops, r.drive_ms) if r.success else None) == want, (rid, s, t, limit)
        assert (rid in steps) == (want is not None)
        if want:
            path = steps[rid]
            assert path[0].node == s and path[-1].node == t and [x.seq for x in path] == list(range(want[1] + 1))
            assert all(arc[y.arc_id][1:3] == (x.node, y.node) for x, y in zip(path, path[1:], strict=False))
            assert sum(arc[x.arc_id][3] for x in path[1:]) == want[0]


def grid(spark, n):
    g, rows = np.random.default_rng(1), []
    for y in range(n):
        for x in range(n):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < n and y + dy < n:
                    a, b, m = y * n + x, (y + dy) * n + x + dx, int(g.integers(80, 140))
                    rows += [(f"{a}-{b}", a, b, m, 30), (f"{b}-{a}", b, a, m, 30)]
    return rows, (spark.createDataFrame(rows, "arc_id string, src long, dst long, distance_m long, speed_kmh int"),
                  spark.createDataFrame([(y * n + x, 50 + y * 0.001, 3 + x * 0.0015) for y in range(n) for x in range(n)], "id long, lat double, lon double"))


def test_few_entry_labels_are_written(spark):
    rows, (a, nodes) = grid(spark, 40)
    asked = [(i, int(s), int(t)) for i, (s, t) in enumerate(np.random.default_rng(4).integers(0, 1600, (10, 2)))]
    p = RB.goal_paths(RB.build_road_blocks(a, nodes, per_block=400, landmarks=3), spark.createDataFrame(asked, "request_id long, source long, target long"))
    got = {r.request_id: r.distance_m for r in p.routes.collect()}
    assert got == {i: least(rows, s, None)[t][0] for i, s, t in asked}
    # A search that labels all nodes writes 1 600 rows and more a request.
    assert p.written < 10 * 1600 / 4 and p.rounds < 15


def test_totals_need_no_steps(spark, monkeypatch):
    _, (a, nodes) = grid(spark, 8)
    req = spark.createDataFrame([(1, 50.0001, 3.0, 50.004, 3.003, 50.007, 3.0105, 20, 0.5), (2, 50.0, 3.0, 50.0, 3.0, 50.001, 3.0, None, 1.0), (3, 50.0, 3.0, 10.0, 3.0, 50.0, 3.0, 5, 1.0)],
                                "request_id long, from_lat double, from_lon double, via_lat double, via_lon double, to_lat double, to_lon double, max_speed_kmh int, multiplier double")
    with_points = JR.job_routes(req, a, nodes)
    last = {r.request_id: r for r in with_points.points.groupBy("request_id").agg(F.max("cum_time_ms").alias("ms"), F.max("cum_dist_m").alias("m")).collect()}
    monkeypatch.setattr(RB, "_traced", lambda *x: pytest.fail("steps were built"))
    roads = RB.build_road_blocks(a, nodes, per_block=30, landmarks=2)
    totals = {r.request_id: r for r in JR.job_routes(req, a, nodes, points=False, roads=roads).totals.collect()}
    assert set(totals) == set(last) == {1, 2}
    for rid, r in totals.items():
        assert abs(r.travel_ms - last[rid].ms) <= 2 and abs(r.distance_m - last[rid].m) <= 2
    short = JR.job_routes(req, a, nodes, points=False, max_m=300.0, roads=roads).totals
    assert {r.request_id for r in short.collect()} == {2}


def test_generation_rejects_detours_only_where_roads_make_them(spark):
    """Two banks of a river, joined far away: pairs across it are driven all round."""
    n, arcs, nodes = 30, [], []
    for bank in (0, 1):
        nodes += [(bank * 1000 + i, 50.0 + bank * 0.02, 3.0 + i * 0.002) for i in range(n)]
        for i in range(n - 1):
            for x, y in ((i, i + 1), (i + 1, i)):
                arcs.append((f"{bank}:{x}-{y}", bank * 1000 + x, bank * 1000 + y, 143, 50))
    arcs += [("over", n - 1, 1000 + n - 1, 90_000, 50), ("back", 1000 + n - 1, n - 1, 90_000, 50)]
    a = spark.createDataFrame(arcs, "arc_id string, src long, dst long, distance_m long, speed_kmh int")
    spots = spark.createDataFrame(nodes, "id long, lat double, lon double")
    out = GN.generate_jobs(spots, None, GN.graph_router(a, spots), seed=5, mode="all", ranges={t: (0.2, 6.0) for t in range(1, 9)})
    jobs, rejects = out.jobs.collect(), out.rejects.collect()
    assert len(jobs) + len(rejects) == 2 * n and jobs and rejects
    assert {r.reason for r in rejects} == {"detour"}
    for r in jobs:
        assert (r.start_address < 1000) == (r.end_address < 1000)
        assert r.km == pytest.approx(abs(r.start_address - r.end_address) * 0.143)


def test_small_components_take_no_rounds(spark):
    """Many little graphs: searched in place, without landmarks or entry labels."""
    g = np.random.default_rng(9)
    arcs = [(f"{c}/{i}", 10 * c + int(a), 10 * c + int(b), int(m), int(v)) for c in range(40) for i, (a, b, m, v) in enumerate(
        zip(g.integers(0, 8, 14), g.integers(0, 8, 14), g.integers(0, 9, 14), g.choice([0, 5, 30], 14), strict=True))]
    nodes = [(10 * c + i, 50.0 + c / 100, 3.0 + i / 100) for c in range(40) for i in range(8)]
    asked = [(c, 10 * c + int(a), 10 * c + int(b), int(v) if v else None) for c, (a, b, v) in enumerate(
        zip(g.integers(0, 8, 40), g.integers(0, 8, 40), g.choice([0, 10], 40), strict=True))] + [(90, 3, 15, None)]
    a = spark.createDataFrame(arcs, "arc_id string, src long, dst long, distance_m long, speed_kmh int")
    requests = spark.createDataFrame(asked, "request_id long, source long, target long, max_speed_kmh int")
    roads = RB.build_road_blocks(a, spark.createDataFrame(nodes, "id long, lat double, lon double"), per_block=50, landmarks=2)
    p = RB.goal_paths(roads, requests, with_steps=True)
    assert (roads.rounds, roads.written, p.rounds, p.written) == (0, 0, 0, 0)
    arc, steps = {x[0]: x for x in arcs}, {}
    for r in p.steps.orderBy("request_id", "seq").collect():
        steps.setdefault(r.request_id, []).append(r)
    for r in p.routes.collect():
        _, s, t, limit = next(x for x in asked if x[0] == r.request_id)
        want = (0, 0, 0) if s == t else least(arcs, s, limit).get(t)
        assert ((r.distance_m, r.hops, r.drive_ms) if r.success else None) == want
        if want:
            path = steps[r.request_id]
            assert path[0].node == s and path[-1].node == t and len(path) == want[1] + 1
            assert sum(arc[x.arc_id][3] for x in path[1:]) == want[0]


def test_small_components_are_traced_with_the_search(spark, monkeypatch):
    """Their paths are not searched again, so no entry row or block is dealt out for them."""
    a = spark.createDataFrame([(f"a{i}", i, i + 1, 5, 30) for i in range(6)], "arc_id string, src long, dst long, distance_m long, speed_kmh int")
    n = spark.createDataFrame([(i, 50.0 + i / 100, 3.0) for i in range(7)], "id long, lat double, lon double")
    asked = spark.createDataFrame([(1, 0, 4), (2, 5, 2), (3, 3, 3)], "request_id long, source long, target long")
    monkeypatch.setattr(RB, "_traced", lambda *a: pytest.fail("searched again"))
    p = RB.goal_paths(RB.build_road_blocks(a, n), asked, with_steps=True)
    assert [tuple(r) for r in p.steps.orderBy("request_id", "seq").collect()] == [
        (1, 0, 0, None), (1, 1, 1, "a0"), (1, 2, 2, "a1"), (1, 3, 3, "a2"), (1, 4, 4, "a3"), (3, 0, 3, None)]


def test_written_tables_leave_no_shuffle_files(spark):
    from terraloom import scratch

    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    was, before = files(), spark.conf.get(scratch._CLEANUP, None)
    df = scratch.cut(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while files() - was and time.time() < until:
        time.sleep(0.2)
    assert not files() - was and df.count() == 10 and spark.conf.get(scratch._CLEANUP, None) == before
