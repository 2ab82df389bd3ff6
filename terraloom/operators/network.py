"""Road-network building, reports, components and way simplification."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import tags as T
from ..scratch import cut, cut_with, sized
from .elements import Osm, located_nodes, way_members
from .ranking import dense_positions
from .ways import direction, profile_speed, routable


def way_pairs(ways: DataFrame, nodes: DataFrame, keep: list[str] | None = None, positions: bool = False) -> DataFrame:
    """Consecutive located nodes along each way: way_id, seq, src, dst.

    References to missing nodes are dropped first and the neighbours on both
    sides become consecutive. ``keep`` names way columns to carry along;
    ``positions`` adds lat1, lon1, lat2, lon2 from the same node join.
    """
    keep = keep or []
    at = ["lat", "lon"] if positions else []
    spots = located_nodes(nodes).select(F.col("id").alias("node_id"), *at)
    used = ways.where(F.size("refs") >= 2)
    members = used.select(F.col("id").alias("way_id"), *keep, F.posexplode("refs").alias("pos", "node_id"))
    found = members.join(spots, "node_id")
    along = W.partitionBy("way_id").orderBy("pos")
    nxt = F.lead(F.struct("node_id", *at)).over(along)
    pairs = found.withColumn("_next", nxt).where(F.col("_next").isNotNull())
    more = [
        F.col(c).alias(n) for c, n in (("lat", "lat1"), ("lon", "lon1"), ("_next.lat", "lat2"), ("_next.lon", "lon2"))
    ] if positions else []
    return pairs.select("way_id", F.col("pos").alias("seq"), F.col("node_id").alias("src"), F.col("_next.node_id").alias("dst"), *keep, *more)


def build_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected, distinct edges; a repeated pair keeps the highest way id."""
    pairs = way_pairs(ways.withColumn("highway", T.tag("tags", "highway")), nodes, ["highway"])
    return pairs.groupBy(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).agg(F.max(F.struct("way_id", "highway")).alias("_w")).select("src", "dst", "_w.way_id", "_w.highway")


def build_arcs(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed arcs: whole metres and the way's profile speed."""
    marked = ways.select("id", "refs", direction("tags").alias("dir"), profile_speed("tags").alias("speed_kmh"))
    pairs = way_pairs(marked, nodes, ["dir", "speed_kmh"], positions=True)
    measured = pairs.where(F.col("src") != F.col("dst"))
    measured = measured.withColumn("distance_m", F.floor(geo.haversine_m("lat1", "lon1", "lat2", "lon2")).cast("long"))
    ends = F.array(
        F.struct(F.lit(0).alias("back"), F.col("src").alias("s"), F.col("dst").alias("d")),
        F.struct(F.lit(1).alias("back"), F.col("dst").alias("s"), F.col("src").alias("d")),
    )
    both = measured.select("way_id", "seq", "dir", "speed_kmh", "distance_m", F.inline(ends))
    ok = (F.col("dir") == "both") | ((F.col("dir") == "forward") & (F.col("back") == 0)) | (
        (F.col("dir") == "backward") & (F.col("back") == 1)
    )
    return both.where(ok).select(
        F.concat_ws(":", "way_id", "seq", "back").alias("arc_id"),
        F.col("s").alias("src"), F.col("d").alias("dst"), "way_id", "distance_m", "speed_kmh",
    )


def _share(part: Column, total: Column) -> Column:
    return part * 100.0 / total


def highway_types(ways: DataFrame) -> DataFrame:
    """Ways per highway value and its percentage."""
    tagged = ways.select(T.tag("tags", "highway").alias("highway")).where(F.col("highway").isNotNull())
    counts = tagged.groupBy("highway").agg(F.count(F.lit(1)).alias("ways"))
    total = counts.agg(F.sum("ways")).scalar()
    return counts.withColumn("percent", _share(F.col("ways"), total))


def road_type_report(ways: DataFrame) -> DataFrame:
    """Routable ways per class and per group; group rows have a null class."""
    h = ways.where(routable("tags")).select(T.tag("tags", "highway").alias("highway"))
    h = h.groupBy("highway").agg(F.count(F.lit(1)).alias("n")).withColumn("road_group", T.highway_group("highway"))
    out = h.rollup("road_group", "highway").agg(F.sum("n").alias("ways"))
    total = h.agg(F.sum("n")).scalar()
    return out.where(F.col("road_group").isNotNull()).withColumn("percent", _share(F.col("ways"), total))


def _nodes_with_group(ways: DataFrame) -> DataFrame:
    return ways.where(routable("tags")).select(
        T.highway_group(T.tag("tags", "highway")).alias("road_group"), F.explode("refs").alias("node_id")
    )


def nodes_by_group(ways: DataFrame) -> DataFrame:
    """Distinct nodes and node references per group, with share of all nodes."""
    uses = _nodes_with_group(ways).groupBy("road_group", "node_id").agg(F.count(F.lit(1)).alias("uses"))
    total = ways.where(routable("tags")).select(F.explode("refs").alias("n")).distinct().agg(F.count(F.lit(1))).scalar()
    return uses.groupBy("road_group").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("uses").alias("node_refs")
    ).withColumn("percent", _share(F.col("nodes"), total))


def pruning_scenarios(ways: DataFrame) -> DataFrame:
    """Nodes left when keeping major, then minor, then link roads too."""
    ranks = {g: i for i, g in enumerate(T.HIGHWAY_GROUPS)}
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("road_group")], F.lit(len(ranks)))
    best = _nodes_with_group(ways).groupBy("node_id").agg(F.min(rank).alias("best"))
    counts = best.agg(
        F.sum(F.when(F.col("best") <= 0, 1).otherwise(0)).alias("major"),
        F.sum(F.when(F.col("best") <= 1, 1).otherwise(0)).alias("major_minor"),
        F.sum(F.when(F.col("best") <= 2, 1).otherwise(0)).alias("major_minor_link"),
        F.count(F.lit(1)).alias("all"),
    )
    names = ["major", "major_minor", "major_minor_link", "all"]
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(n).alias("nodes")) for n in names])
    return counts.select(F.inline(rows), F.col("all").alias("_all")).select(
        "scenario", "nodes", _share(F.col("nodes"), F.greatest("_all", F.lit(1))).alias("percent")
    )


def ref_pairs(ways: DataFrame) -> DataFrame:
    """Neighbouring references of routable ways, located or not: src, dst.

    Neighbours stand side by side in ``refs``, so nothing is shuffled.
    """
    used = ways.where(routable("tags") & (F.size("refs") >= 2))
    n = F.size("refs") - 1
    zipped = F.zip_with(F.slice("refs", F.lit(1), n), F.slice("refs", F.lit(2), n), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return used.select(F.inline(zipped))


def degrees(pairs: DataFrame) -> DataFrame:
    """Degree per node: both ends of each pair count, repeats included."""
    return pairs.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("degree")
    )


def degree_distribution(pairs: DataFrame, top: int = 20) -> DataFrame:
    """Nodes per degree up to ``top``, the rest in one row, and shares."""
    label = F.when(F.col("degree") <= top, F.col("degree").cast("string")).otherwise(F.lit(f">{top}"))
    counts = degrees(pairs).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.groupBy(label.alias("degree")).agg(F.sum("n").alias("nodes")).withColumn(
        "percent", _share(F.col("nodes"), total)
    )


def connectivity_stats(pairs: DataFrame) -> DataFrame:
    """Nodes of degree 1, 2, 3 and above, and the gain of merging degree 2."""
    def count_if(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))
    d = F.col("degree")
    out = degrees(pairs).agg(
        F.count(F.lit(1)).alias("nodes"), count_if(d == 1).alias("degree_1"), count_if(d == 2).alias("degree_2"),
        count_if(d == 3).alias("degree_3"), count_if(d >= 4).alias("degree_4_plus"),
    )
    return out.withColumn("merge_reduction_percent", _share(F.col("degree_2"), F.greatest("nodes", F.lit(1))))


# Nodes that a task's disjoint sets hold before they are handed on.
FOREST_NODES = 2_000_000


def partition_forests(edges: DataFrame) -> DataFrame:
    """u, v: edges that connect what ``edges`` (u, v, whole numbers) connect.

    Disjoint sets of the edges of a partition; every node has one edge at
    most, to the smallest node of its set. A partition of more than
    ``FOREST_NODES`` nodes hands on several forests, so its memory is bounded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def forest() -> Iterator[pa.RecordBatch]:
            nodes = [n for n in parent if root(n) != n]
            for i in range(0, len(nodes), 100_000):
                part = nodes[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([parent[n] for n in part], pa.int64())], ["u", "v"])
            parent.clear()

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                low, high = sorted((root(u), root(v)))
                parent[high] = low
            if len(parent) >= FOREST_NODES:
                yield from forest()
        yield from forest()

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, forests: bool = False) -> DataFrame:
    """(node_id, component): component is the smallest node id reachable.

    Randomised contraction (Boegeholz et al. 2020). In a round every node goes
    over to that of its neighbours and itself whose hash is least, edges follow
    their ends, and those within one node go. Whatever the shape of the graph,
    a round leaves a fixed share of the nodes on average, and a component that
    is one node takes no part any more, so all rounds together cost little more
    than the first. A hub is one row of a combining aggregate and no neighbour
    list is ever collected. ``forests`` first leaves each partition with one
    edge a node, which pays where neighbouring edges lie together, as along ways.
    """
    given = cut(edges.select("src", "dst"))
    work = given.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v")
    if forests:
        work = partition_forests(work.select(F.col("u").cast("long"), F.col("v").cast("long")))
    work, seen = cut_with(work.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    moves: list[DataFrame] = []
    while seen["rows"]:
        turn = F.lit(len(moves))
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(F.xxhash64(turn, "v").alias("h"), "v")).alias("m"))
        own = F.struct(F.xxhash64(turn, "u").alias("h"), F.col("u").alias("v"))
        to, to_seen = cut_with(least.select("u", F.least("m", own)["v"].alias("to")))
        moves.append(to)
        to = sized(to, to_seen["rows"])
        ends = work.join(to.withColumnRenamed("to", "a"), "u").join(to.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        work, seen = cut_with(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    # From the last round back: where the node went that a node went to.
    linked = work.select("u", F.col("v").alias("to"))
    for to in reversed(moves):
        further = linked.select(F.col("u").alias("to"), F.col("to").alias("_end"))
        linked = cut(to.join(further, "to", "left").select("u", F.coalesce("_end", "to").alias("to")))
    lowest = linked.groupBy("to").agg(F.min("u").alias("component"))
    linked = linked.join(lowest, "to").select(F.col("u").alias("node_id"), "component")
    # Nodes that have no edge to another one.
    loops = given.where(~F.coalesce(F.col("src") != F.col("dst"), F.lit(False)))
    alone = loops.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().join(linked, "node_id", "left_anti")
    return linked.unionByName(alone.select("node_id", F.col("node_id").alias("component")))


def largest_component(components: DataFrame) -> DataFrame:
    """Nodes of the biggest component; of equal ones the smaller id."""
    top = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(
        F.desc("size"), "component"
    ).limit(1)
    return components.join(F.broadcast(top.select("component")), "component", "left_semi").select("node_id")


def component_report(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rank, size, share, sample point and bounds of each component."""
    placed = components.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    sizes = placed.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct("node_id", "lat", "lon")).alias("sample"),
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
    )
    sizes = cut(sizes)
    total = sizes.agg(F.sum("size")).scalar()
    ranked = dense_positions(sizes, [F.desc("size"), F.desc("component")], name="rank", start=1)
    return ranked.select(
        F.col("rank").cast("long").alias("rank"), "component", "size", _share(F.col("size"), total).alias("percent"),
        F.col("sample.node_id").alias("sample_node"), F.col("sample.lat").alias("sample_lat"),
        F.col("sample.lon").alias("sample_lon"), "south", "north", "west", "east",
    )


def component_of(components: DataFrame, report: DataFrame, asked: DataFrame) -> DataFrame:
    """Component, rank and size for each asked ``node_id``."""
    return asked.join(components, "node_id").join(report.select("component", "rank", "size"), "component")


def trim_to_component(osm: Osm, members: DataFrame) -> Osm:
    """Nodes in ``members``, ways touching any of them, all relations."""
    keep = members.select(F.col("node_id").alias("id"))
    nodes = osm.nodes.join(keep, "id", "left_semi")
    touching = way_members(osm.ways).join(members, "node_id", "left_semi").select(F.col("way_id").alias("id"))
    return Osm(nodes, osm.ways.join(touching, "id", "left_semi"), osm.relations)


def trim_stats(before: Osm, after: Osm) -> DataFrame:
    """Kept and total elements per kind with the percentage."""
    out = None
    for kind, a, b in (("node", before.nodes, after.nodes), ("way", before.ways, after.ways),
                       ("relation", before.relations, after.relations)):
        total = a.agg(F.count(F.lit(1))).scalar()
        one = b.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(kind).alias("kind"), "kept", total.alias("total"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("percent", F.when(F.col("total") > 0, _share(F.col("kept"), F.col("total"))).otherwise(0.0))


def kept_nodes(ways: DataFrame) -> DataFrame:
    """Endpoints of routable ways with two or more references."""
    ends = ways.where(routable("tags") & (F.size("refs") >= 2))
    return ends.select(F.explode(F.array(F.col("refs")[0], F.element_at("refs", -1))).alias("node_id")).distinct()


def simplify_ways(
    ways: DataFrame, nodes: DataFrame, kept: DataFrame | None = None, legacy: bool = False
) -> DataFrame:
    """Routable ways cut down to endpoints and kept nodes, with lengths.

    ``length_m`` and ``seg_length_m`` follow the original line; steps to or
    from an unlocated node add nothing; rounding is half-even. ``legacy``
    ends the walk at the first occurrence of the last node, which makes a
    closed way's length 0. Ways left with one node are dropped.
    """
    usable = ways.where(routable("tags") & (F.size("refs") >= 2))
    kept = kept_nodes(ways) if kept is None else kept
    members = usable.select(
        F.col("id").alias("way_id"), F.size("refs").alias("orig_nodes"), F.element_at("refs", -1).alias("last_ref"),
        F.col("refs")[0].alias("first_ref"), F.posexplode("refs").alias("pos", "node_id"),
    )
    flags = kept.select("node_id", F.lit(True).alias("_kept"))
    spots = located_nodes(nodes).select(F.col("id").alias("node_id"), "lat", "lon")
    rows = members.join(flags, "node_id", "left").join(spots, "node_id", "left")
    rows = rows.withColumn("end", (F.col("pos") == 0) | (F.col("pos") == F.col("orig_nodes") - 1))
    rows = rows.withColumn("candidate", F.col("end") | F.col("_kept").isNotNull())
    along = W.partitionBy("way_id").orderBy("pos")
    step = geo.haversine_m(F.lag("lat").over(along), F.lag("lon").over(along), "lat", "lon")
    rows = rows.withColumn("step_m", F.coalesce(step, F.lit(0.0)))
    # The nearest candidate before this one, whose repeat is skipped.
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("candidate"), F.col("node_id")), ignorenulls=True).over(earlier)
    rows = rows.withColumn("stay", F.col("candidate") & (prev.isNull() | (prev != F.col("node_id"))))
    if legacy:
        rows = rows.withColumn("stop", F.min(F.when(F.col("node_id") == F.col("last_ref"), F.col("pos"))).over(
            W.partitionBy("way_id")))
        names = F.collect_set(F.when(F.col("stay"), F.col("node_id"))).over(W.partitionBy("way_id"))
        closes = F.array_contains(names, F.col("node_id")) & (F.col("node_id") != F.col("first_ref"))
        rows = rows.withColumn("closes", closes & (F.col("pos") <= F.col("stop")))
        rows = rows.withColumn("step_m", F.when(F.col("pos") <= F.col("stop"), F.col("step_m")).otherwise(0.0))
    else:
        rows = rows.withColumn("closes", F.col("stay") & (F.col("pos") > 0))
    # A segment runs up to and including the row that closes it.
    seg = F.coalesce(F.sum(F.col("closes").cast("int")).over(earlier), F.lit(0))
    rows = rows.withColumn("seg", seg)
    per_seg = rows.groupBy("way_id", "seg").agg(
        F.first("orig_nodes").alias("orig_nodes"),
        F.sum("step_m").alias("seg_m"), F.max("closes").alias("closed"),
        F.array_sort(F.collect_list(F.when(F.col("stay"), F.struct("pos", "node_id")))).alias("stays"),
    )
    per_way = per_seg.groupBy("way_id").agg(
        F.first("orig_nodes").alias("orig_nodes"), F.sum("seg_m").alias("total_m"),
        F.array_sort(F.flatten(F.collect_list("stays"))).alias("stays"),
        F.array_sort(F.collect_list(F.when(F.col("closed"), F.struct("seg", F.bround("seg_m").cast("long").alias("m"))))).alias("segs"),
    )
    wanted = F.size("stays") - 1
    got = F.transform("segs", lambda s: s["m"])
    padded = F.slice(F.concat(got, F.array_repeat(F.lit(0).cast("long"), F.greatest(wanted - F.size("segs"), F.lit(0)))), 1, wanted)
    lines = per_way.where(F.size("stays") >= 2).select(
        F.col("way_id").alias("id"),
        F.transform("stays", lambda s: s["node_id"]).alias("refs"),
        F.bround("total_m").cast("long").alias("length_m"), F.col("orig_nodes").cast("int").alias("orig_nodes"),
        F.size("stays").alias("kept_nodes"), padded.alias("seg_length_m"),
    )
    kmh = T.posted_kmh("tags", "token")
    out = lines.join(usable.select("id", "tags"), "id")
    return out.withColumn(
        "duration_s",
        F.when(kmh > 0, F.bround(F.col("length_m") / 1000.0 / kmh * 3600.0).cast("long")),
    )


def with_simplified_tags(simplified: DataFrame) -> DataFrame:
    """Put the measured figures into the way tags as text."""
    extra = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in (
            ("length_m", F.col("length_m").cast("string")), ("orig_nodes", F.col("orig_nodes").cast("string")),
            ("kept_nodes", F.col("kept_nodes").cast("string")), ("duration_s", F.col("duration_s").cast("string")),
            ("seg_length_m", F.array_join(F.col("seg_length_m").cast("array<string>"), ";")),
        )
    ]), lambda e: e["v"].isNotNull()))
    clash = F.map_filter("tags", lambda k, _v: ~F.map_contains_key(extra, k))
    return simplified.withColumn("tags", F.map_concat(clash, extra)).select("id", "refs", "tags")


def arc_stats(arcs: DataFrame) -> DataFrame:
    """Arc travel times: whole seconds as ms, at most a day; odd arcs counted."""
    seconds = F.least(
        F.floor(F.col("distance_m") * 3600 / F.nullif(F.col("speed_kmh") * 1000, F.lit(0))), F.lit(86400)
    ).cast("long")
    ok = (F.col("speed_kmh") > 0) & (F.col("distance_m") > 0)
    timed = arcs.select(F.when(ok, seconds * 1000).alias("ms"))
    return timed.agg(
        F.count(F.lit(1)).alias("arcs"),
        F.min(F.when(F.col("ms") > 0, F.col("ms"))).alias("min_ms"),
        F.max(F.when(F.col("ms") > 0, F.col("ms"))).alias("max_ms"),
        F.sum(F.when(F.col("ms") == 0, 1).otherwise(0)).alias("zero"),
        F.sum(F.when(F.col("ms").isNull(), 1).otherwise(0)).alias("infinite"),
    )
