import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import elements as EL
from terraloom.operators import jobroutes as JR
from terraloom.operators import network as NW
from terraloom.operators import routing as RT
from terraloom.scratch import cut_with
from terraloom.sources.readers import NODE_SCHEMA, RELATION_SCHEMA, WAY_SCHEMA
from terraloom.operators.regions import REGION_SCHEMA, build_cover

ROAD = {"highway": "residential"}


def line_nodes(spark, ids, step=0.001):
    return spark.createDataFrame([(i, 0.0, 1.0 + step * k, {}) for k, i in enumerate(ids)], NODE_SCHEMA)


def ways_of(spark, rows):
    return spark.createDataFrame(rows, WAY_SCHEMA)


def test_simplified_refs_and_segments(spark):
    nodes = line_nodes(spark, [1, 2, 3, 4, 5])
    ways = ways_of(spark, [(9, [1, 2, 3, 4, 5], {**ROAD, "maxspeed": "30"})])
    kept = spark.createDataFrame([(3,)], "node_id long")
    r = NW.simplify_ways(ways, nodes, kept).first()
    assert r.refs == [1, 3, 5] and len(r.seg_length_m) == 2 and r.orig_nodes == 5 and r.kept_nodes == 3
    assert abs(sum(r.seg_length_m) - r.length_m) <= 5
    assert r.duration_s == round(r.length_m / 1000 / 30 * 3600)
    tags = NW.with_simplified_tags(NW.simplify_ways(ways, nodes, kept)).first().tags
    assert tags["seg_length_m"] == ";".join(map(str, r.seg_length_m)) and tags["highway"] == "residential"
    plain = NW.simplify_ways(ways_of(spark, [(1, [1, 2, 3, 4], ROAD)]), nodes, kept.limit(0)).first()
    assert plain.refs == [1, 4]


def test_simplify_edge_cases(spark):
    nodes = line_nodes(spark, [1, 2, 3])
    rows = [(1, [1, 2, 1], ROAD), (2, [1, 99, 3], ROAD), (3, [1], ROAD), (4, [1, 2], {"highway": "platform"}), (5, [1, 2, 3, 1], ROAD)]
    kept = spark.createDataFrame([(2,)], "node_id long")
    got = {r.id: r for r in NW.simplify_ways(ways_of(spark, rows), nodes, kept).collect()}
    assert set(got) == {1, 2, 5} and got[1].refs == [1, 2, 1]
    assert got[2].length_m == 0 and got[5].length_m > 0
    legacy = {r.id: r for r in NW.simplify_ways(ways_of(spark, rows), nodes, kept, legacy=True).collect()}
    assert legacy[5].length_m == 0 and legacy[5].seg_length_m == [0, 0]
    none = NW.simplify_ways(ways_of(spark, [(1, [1, 3, 1], ROAD)]), nodes, kept)
    assert none.isEmpty()


def components_by_hand(edges):
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_with_hub_and_chain(spark):
    g = np.random.default_rng(2)
    edges = [(0, int(i)) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1080)]
    edges += [(int(a), int(b)) for a, b in g.integers(2000, 2200, (120, 2))] + [(5000, 5000)]
    got = NW.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node_id: r.component for r in got.collect()} == components_by_hand(edges)
    nodes = got.select(F.col("node_id").alias("id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    report = NW.component_report(got, nodes).orderBy("rank").collect()
    assert report[0].component == 0 and report[0].size == 300 and sum(r.size for r in report) == got.count()
    assert [r.rank for r in report] == list(range(1, len(report) + 1))
    assert NW.largest_component(got).count() == 300


def test_forests_leave_less_to_shuffle(spark, monkeypatch):
    """Edges along ways, a hub and a dense cluster: equal components, fewer rows written."""
    g = np.random.default_rng(7)
    edges = [(100 * w + k, 100 * w + k + 1) for w in range(60) for k in range(40)] + [(100 * w, 100 * (w + 1)) for w in range(0, 60, 2)]
    edges += [(int(a), int(b)) for a, b in g.integers(20_000, 20_060, (2500, 2))] + [(30_000, 30_000 + k) for k in range(1, 200)] + [(-5, -5)]
    df = spark.createDataFrame(edges, "src long, dst long").coalesce(3)
    want, written = components_by_hand(edges), []
    monkeypatch.setattr(NW, "cut_with", lambda d, old=NW.cut_with, **k: (lambda out: written[-1].append(out[1]["rows"]) or out)(old(d, **k)))
    for forests in (False, True):
        written.append([])
        got = NW.connected_components(df, forests)
        assert {r.node_id: r.component for r in got.collect()} == want
    assert written[1][0] < written[0][0] * 0.7 and sum(written[1]) < sum(written[0])
    monkeypatch.setattr(NW, "FOREST_NODES", 50)
    assert {r.node_id: r.component for r in NW.connected_components(df, True).collect()} == want


def test_degrees_count_repeats(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "src long, dst long")
    assert {r.node_id: r.degree for r in NW.degrees(pairs).collect()} == {1: 2, 2: 3, 3: 1}
    s = NW.connectivity_stats(pairs).first()
    assert (s.nodes, s.degree_1, s.degree_2, s.degree_3, s.degree_4_plus) == (3, 1, 1, 1, 0)


def test_elements(spark):
    nodes = spark.createDataFrame([
        (1, 10.0, 10.0, {"addr:city": "A", "addr:street": "S"}), (2, 10.0, 12.0, {}), (3, 12.0, 12.0, {"building": "house"}),
        (4, 0.0, 0.0, {"building": "house"}), (5, 20.0, 20.0, {}),
    ], NODE_SCHEMA)
    ways = ways_of(spark, [(10, [1, 2, 3, 1], {"building": "yes"}), (11, [5], {}), (12, [99], {"building": "yes"})])
    rel = spark.createDataFrame([(20, [("way", 10, "outer"), ("way", 11, "outer"), ("way", 10, "inner"), ("node", 1, "outer")], {"building": "yes"})], RELATION_SCHEMA)
    osm = EL.Osm(nodes, ways, rel)
    got = {(r.id, r.is_node, r.is_way): r for r in EL.extract_addresses(osm).collect()}
    assert set(got) == {(1, 1, 0), (3, 1, 0), (10, 0, 1), (20, 0, 0)}
    assert got[(1, 1, 0)].city == "A" and got[(1, 1, 0)].is_addr == 1 and got[(3, 1, 0)].is_building == 1
    assert got[(10, 0, 1)].lat == pytest.approx(10.5)  # the closing node counts twice
    assert got[(20, 0, 0)].lat == pytest.approx((10.5 * 4 + 20) / 5)
    assert {r.kind: r.elements for r in EL.element_counts(osm).collect()} == {"node": 5, "way": 3, "relation": 1, "total": 9}


def test_elements_are_built_once_and_spread(spark, monkeypatch):
    from terraloom import scratch

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    nodes = spark.createDataFrame([(i, 50.0 + i / 100, 4.0 + i / 100, {"building": "house"} if i % 2 else {}) for i in range(60)], NODE_SCHEMA)
    ways = ways_of(spark, [(100 + i, [i, i + 1, i + 2], {"building": "warehouse"}) for i in range(50)])
    ways = ways.mapInArrow(count, ways.schema)
    rel = spark.createDataFrame([(20, [("way", 100, "outer"), ("way", 101, "outer")], {"building": "house"})], RELATION_SCHEMA)
    monkeypatch.setattr(scratch, "PART_ROWS", 10)
    spread_by = []
    real = scratch.spread
    monkeypatch.setattr(EL, "spread", lambda df, rows, *keys: spread_by.append(real(df, rows, *keys)) or spread_by[-1])
    got = {(r.id, r.is_way): r for r in EL.extract_addresses(EL.Osm(nodes, ways, rel)).collect()}
    assert seen.value == 50 and len(got) == 30 + 50 + 1
    assert got[(100, 1)].lat == pytest.approx(50.01) and got[(20, 0)].lat == pytest.approx(50.015)
    assert max(d.rdd.getNumPartitions() for d in spread_by) == 15
    square = spark.createDataFrame([("A", "X", "a", [[[(0.0, 6000000.0), (0.0, 7500000.0), (1000000.0, 7500000.0), (1000000.0, 6000000.0)]]])], REGION_SCHEMA)
    seen.value = 0
    places = EL.extract_places(EL.Osm(nodes, ways, rel), EL.category_rules(), build_cover(square)).collect()
    assert seen.value == 50 and {(r.category, r.is_way) for r in places} == {("residential", 0), ("warehouse", 1)} and len(places) == 30 + 50 + 1


def test_category_rules(spark, tmp_path):
    df = spark.createDataFrame([(1, {"office": "x", "shop": "car"}), (2, {"shop": "books"}), (3, {"building": "warehouse"})], "id long, tags map<string,string>")
    got = {r.id: r.c for r in df.select("id", EL.category_of(EL.category_rules()).alias("c")).collect()}
    assert got == {1: "office", 2: None, 3: "warehouse"}
    f = tmp_path / "rules.yaml"
    f.write_text("categories:\n  - name: a\n    tags: [shop=*]\n  - name: b\n    max_per_region: 3\n    tags: [x=1]\n")
    rules = EL.category_rules(str(f))
    assert [(r.name, r.max_per_region) for r in rules] == [("a", 100), ("b", 3)]
    with pytest.raises(ValueError):
        EL.category_rules([("a", ["shop"])])


def dijkstra(arcs, source):
    out, todo = {}, [(0, source)]
    near = {}
    for _a, s, d, w in arcs:
        near.setdefault(s, []).append((d, w))
    while todo:
        d, n = heapq.heappop(todo)
        if n in out:
            continue
        out[n] = d
        for m, w in near.get(n, []):
            heapq.heappush(todo, (d + w, m))
    return out


def test_shortest_paths_match_dijkstra(spark):
    g = np.random.default_rng(3)
    arcs = [(str(i), int(a), int(b), int(w)) for i, (a, b, w) in enumerate(zip(g.integers(0, 80, 200), g.integers(0, 80, 200), g.integers(0, 50, 200)))]
    asked = [(i, int(a), int(b)) for i, (a, b) in enumerate(g.integers(0, 80, (60, 2)))] + [(60, 5, 5), (61, 5, 999)]
    df = spark.createDataFrame(arcs, "arc_id string, src long, dst long, distance_m long")
    for thin in (0, 20_000):
        RT.THIN_FRONT = thin
        p = RT.shortest_paths(df, spark.createDataFrame(asked, "request_id long, source long, target long"))
        routes = {r.request_id: r for r in p.routes.collect()}
        steps = {}
        for r in p.steps.orderBy("request_id", "seq").collect():
            steps.setdefault(r.request_id, []).append(r)
        weight = {a: (s, d, w) for a, s, d, w in arcs}
        for rid, s, t in asked:
            want = dijkstra(arcs, s).get(t)
            assert routes[rid].success == (want is not None or s == t)
            if not routes[rid].success:
                continue
            assert routes[rid].distance_m == (0 if s == t else want)
            path = steps[rid]
            assert path[0].node == s and path[-1].node == t and [r.seq for r in path] == list(range(len(path)))
            for a, b in zip(path, path[1:]):
                assert weight[b.arc_id][:2] == (a.node, b.node)
            assert sum(weight[r.arc_id][2] for r in path[1:]) == routes[rid].distance_m
    RT.THIN_FRONT = 20_000


def test_small_components_are_searched_in_place(spark, monkeypatch):
    # Ties in length and hops, parallel arcs, one-way arcs.
    arcs = [("a", 0, 1, 2), ("b", 0, 1, 2), ("c", 0, 2, 1), ("d", 2, 1, 1), ("e", 1, 3, 0), ("f", 2, 3, 1), ("g", 4, 3, 1), ("h", 3, 5, 2), ("i", 1, 5, 2), ("j", 9, 8, 1)]
    asked = [(0, 0, 3), (1, 0, 5), (2, 3, 0), (3, 4, 5), (4, 0, 4), (5, 9, 8), (6, 9, 1), (7, None, 1), (8, 777, 777), (9, 0, 5)]
    columns, requests = "arc_id string, src long, dst long, distance_m long", "request_id long, source long, target long"
    written = []
    monkeypatch.setattr(RT, "cut_with", lambda *a, **k: written.append(1) or cut_with(*a, **k))

    def rows(arcs, asked):
        p = RT.shortest_paths(spark.createDataFrame(arcs, columns), spark.createDataFrame(asked, requests), 20)
        return sorted(map(tuple, p.routes.collect()), key=str), sorted(map(tuple, p.steps.collect()), key=str)

    line = [(f"l{i}", 100 + i, 101 + i, 1) for i in range(40)]
    near = rows(arcs + line, asked + [(10, 100, 118), (11, 100, 121)])
    assert len(written) < 8  # does not follow the hops
    assert {r[0]: r[4] for r in near[0] if r[3]} == {0: 2, 1: 4, 3: 3, 5: 1, 8: 0, 9: 4, 10: 18}
    monkeypatch.setattr(RT, "NEAR_NODES", 0)
    far = rows(arcs, asked)
    assert far[0] == [r for r in near[0] if r[0] < 10] and far[1] == [r for r in near[1] if r[0] < 10]


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = line_nodes(spark, [1, 2, 3, 4])
    ways = ways_of(spark, [(7, [1, 2, 3, 4], {"highway": "residential", "maxspeed": "30"})])
    return NW.build_arcs(ways, nodes), nodes


def test_points_end_at_total_time(spark, small_graph):
    arcs, nodes = small_graph
    req = spark.createDataFrame([(1, 0.0001, 1.0, 0.0001, 1.003, None), (2, 0.0001, 1.0, 0.0001, 1.003, 10), (3, 0.0001, 1.0, 0.0002, 1.0, 20), (4, 50.0, 50.0, 0.0, 1.0, None)],
                                "request_id long, from_lat double, from_lon double, to_lat double, to_lon double, max_speed_kmh int")
    legs = RT.snap(req, nodes)
    p = RT.shortest_paths(arcs, legs)
    times = {r.request_id: r for r in RT.travel_time(legs, p.steps, arcs).collect()}
    pts = RT.route_points(legs, p.steps, arcs, nodes).toPandas()
    assert set(times) == {1, 2, 3} and times[1].hops == 3 and times[3].hops == 0
    for rid, part in pts.groupby("request_id"):
        part = part.sort_values("seq")
        assert list(part.seq) == list(range(len(part)))
        assert abs(part.cum_time_ms.iloc[-1] - times[rid].travel_ms) <= 1
        assert part.is_walking.iloc[0] and part.is_walking.iloc[-1] and part.cum_time_ms.is_monotonic_increasing
    assert times[2].travel_ms > times[1].travel_ms
    quirk = {r.request_id: r.travel_ms for r in RT.travel_time(legs, p.steps, arcs, keep_quirk=True).collect()}
    assert quirk[3] == 0 and quirk[1] == times[1].travel_ms
    jr = JR.job_routes(spark.createDataFrame([(1, 0.0001, 1.0, 0.0, 1.001, 0.0001, 1.003, 0.5)],
                       "request_id long, from_lat double, from_lon double, via_lat double, via_lon double, to_lat double, to_lon double, multiplier double"), arcs, nodes)
    total, last = jr.totals.first(), jr.points.orderBy(F.desc("seq")).first()
    assert abs(total.travel_ms - last.cum_time_ms) <= 2 and jr.points.select("seq").distinct().count() == jr.points.count()


def path_points(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)],
                                 "route_id long, seq int, lat double, lon double, cum_time_s double, cum_dist_m double, max_speed_kmh double, is_walking boolean")


def test_position_at_time(spark):
    pts = path_points(spark, [(52.0, 5.0, 0.0, 0.0, 0.0, True), (52.01, 5.0, 10.0, 250.0, 30.0, False), (52.01, 5.02, 20.0, 500.0, 50.0, False)])
    q = spark.createDataFrame([(i, 1, t) for i, t in enumerate((-5.0, 0.0, 5.0, 10.0, 15.0, 20.0, 99.0))] + [(7, 2, 1.0)], "query_id int, route_id long, at_s double")
    got = {r.query_id: (r.lat, r.lon) for r in RT.position_at(pts, q).collect()}
    assert got[0] == got[1] == (52.0, 5.0) and got[3] == (52.01, 5.0) and got[5] == got[6] == (52.01, 5.02)
    assert got[2][0] == pytest.approx(52.005, abs=1e-6) and got[4][1] == pytest.approx(5.01, abs=1e-5)
    assert got[7] == (None, None)


@pytest.mark.parametrize("m", [0.5, 1.0, 2.0])
def test_speed_cap(spark, m):
    pts = path_points(spark, [(0.0, 0.0, 0.0, 0.0, 0.0, True), (0.0, 0.1, 10.0, 100.0, 6.0, True), (0.0, 0.2, 20.0, 300.0, 50.0, False), (0.0, 0.3, 30.0, 600.0, 20.0, False)])
    got = RT.cap_speed(pts, 25.0, m).orderBy("seq").collect()
    assert [r.cum_time_s for r in got] == [0.0, 10 * m, 30 * m, 40 * m]
    assert [r.max_speed_kmh for r in got] == [0.0, 6.0, 25.0, 20.0]
    both = RT.concat_routes(pts, pts).orderBy("seq").collect()
    assert len(both) == 8 and both[-1].cum_time_s == 60.0 and both[-1].cum_dist_m == 1200.0


def test_way_centres_do_not_depend_on_order(spark):
    import itertools

    lons = [3.0 + 5.0 * (k * 104729 % 10009) / 10009 for k in (1, 77, 4242, 9001, 123456)]
    nodes = spark.createDataFrame([(i, 51.0, x) for i, x in enumerate(lons)], "id long, lat double, lon double")
    orders = list(itertools.permutations(range(len(lons))))
    ways = spark.createDataFrame([(n, list(o)) for n, o in enumerate(orders)], "id long, refs array<long>").coalesce(1)
    got = EL.way_points(ways, nodes.coalesce(1)).select("lon").distinct().collect()
    assert [r.lon for r in got] == [math.fsum(lons) / len(lons)]


def test_finished_components_leave_the_rounds(spark, monkeypatch):
    """Rows written follow the edges, however many rounds the longest path takes."""
    import random

    import terraloom.scratch as scratch
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 4000 + 3000)
    long, short = ids[:4000], ids[4000:]
    edges = list(zip(long, long[1:], strict=False)) + [(a, b) for i, (a, b) in enumerate(zip(short, short[1:], strict=False)) if i % 3 < 2]
    written = []

    def counted(df, **metrics):
        out = real(df, **metrics)
        written.append(out[1]["rows"])
        return out

    real = scratch.cut_with
    monkeypatch.setattr(scratch, "cut_with", counted)
    monkeypatch.setattr(NW, "cut_with", counted)
    got = {r.node_id: r.component for r in NW.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {n: min(long) for n in long}
    want.update({n: min(short[i - i % 3 : i - i % 3 + 3]) for i, n in enumerate(short)})
    assert got == want
    assert sum(written) < 11 * len(edges)
