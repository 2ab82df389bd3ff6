"""Nearest-neighbour joins over an adaptive tile index.

Targets are sorted into tiles that are split eightfold per axis until none
holds more than ``leaf_size`` of them, so a crowded place only makes the tree
deeper there. A query finds the deepest occupied tile it lies in with equi
joins; that tile bounds its distance, and the tiles of the same level within
the bound are looked up by their numbers. Only tiles that are split there are
walked down, and only queries outside all tiles start at the root. At each
step a query keeps only the tiles that can still beat the best upper bound it
has, so it meets a bounded number of tiles and never all points of a hot cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..scratch import BROADCAST_ROWS, cut_with, sized

SPLIT = 8
MAX_DEPTH = 12
ROUNDING = 1.0 + 1e-9
# Squared chords of points less than a metre apart differ by this much at most.
HAIR = 1e-22
CELL = ["grp", "lvl", "ci", "cj"]
_CELL_TYPE = "struct<lvl:int,ci:bigint,cj:bigint,leaf:boolean,lo:double,hi:double,n:bigint>"


def _place(metric: str, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Euclidean coordinates whose distance orders points as the metric does.

    (a, b) is (lat, lon), or (x, y) for ``planar``.
    """
    if metric == "haversine":
        return geo.unit_sphere(a, b)
    if metric == "degrees":
        return b, a, F.lit(0.0)
    if metric == "planar":
        return a, b, F.lit(0.0)
    raise ValueError(f"unknown metric {metric!r}")


@dataclass
class TileIndex:
    metric: str
    k: int
    base: int
    depth: int
    inner: DataFrame
    inner_rows: int
    leaves: DataFrame
    leaf_rows: int
    cells: DataFrame
    cell_rows: dict[int, int]
    corner: tuple[float, float]
    span: float


def build_tile_index(
    targets: DataFrame,
    key: str,
    a: str,
    b: str,
    metric: str = "haversine",
    group: str | None = None,
    k: int = 1,
    leaf_size: int = 64,
) -> TileIndex:
    """Index ``targets`` (key, position, optional equality group)."""
    leaf_size = max(leaf_size, 2 * k)
    ca, cb = F.col(a).cast("double"), F.col(b).cast("double")
    u, v, w = _place(metric, ca, cb)
    p, q = (ca, cb) if metric == "planar" else (cb, ca)
    pts = targets.where(ca.isNotNull() & cb.isNotNull()).select(
        (F.col(group) if group else F.lit(0)).cast("long").alias("grp"),
        F.col(key).alias("id"), ca.alias("a"), cb.alias("b"),
        p.alias("p"), q.alias("q"), u.alias("u"), v.alias("v"), w.alias("w"),
    )
    # Points at one spot beyond the k smallest keys can never be returned.
    if k == 1:
        rest = ["u", "v", "w"]
        pts = pts.groupBy("grp", "a", "b").agg(
            F.min("id").alias("id"), F.first("p").alias("p"), F.first("q").alias("q"),
            *[F.first(c).alias(c) for c in rest],
        )
    else:
        spot = W.partitionBy("grp", "a", "b").orderBy("id")
        pts = pts.withColumn("_r", F.row_number().over(spot)).where(F.col("_r") <= k).drop("_r")
    pts, seen = cut_with(
        pts, p0=F.min("p"), p1=F.max("p"), q0=F.min("q"), q1=F.max("q"),
    )
    rows = seen["rows"]
    p0, q0 = seen["p0"] or 0.0, seen["q0"] or 0.0
    span = max((seen["p1"] or 0.0) - p0, (seen["q1"] or 0.0) - q0, 1e-9) * (1 + 1e-9)
    base = 0
    while rows / leaf_size > (SPLIT * SPLIT) ** (base + 1) and base < MAX_DEPTH:
        base += 1

    def keyed(df: DataFrame, lvl: int) -> DataFrame:
        size = span / SPLIT ** (lvl + 1)
        return df.withColumn("lvl", F.lit(lvl)).withColumn(
            "ci", F.floor((F.col("p") - p0) / size).cast("long")
        ).withColumn("cj", F.floor((F.col("q") - q0) / size).cast("long"))

    box = [f(c).alias(f"{c}{i}") for c in "uvw" for i, f in ((0, F.min), (1, F.max))]
    fold = [f(f"{c}{i}").alias(f"{c}{i}") for c in "uvw" for i, f in ((0, F.min), (1, F.max))]
    members = F.collect_list(F.struct("id", "a", "b", "u", "v", "w")).alias("members")
    cells, leaf_parts, cell_rows = [], [], {}
    pending, lvl = pts, base
    while True:
        at = keyed(pending, lvl)
        last = lvl == MAX_DEPTH
        found, figures = cut_with(
            at.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *box)
            .withColumn("leaf", (F.col("n") <= leaf_size) | F.lit(last)),
            crowded=F.sum(F.when(~F.col("leaf"), 1).otherwise(0)),
        )
        cells.append(found)
        cell_rows[lvl] = figures["rows"]
        crowded = figures["crowded"] or 0
        if crowded == 0:
            leaf_parts.append(at.groupBy(*CELL).agg(members))
            break
        hot = sized(found.where(~F.col("leaf")).select(*CELL), crowded)
        leaf_parts.append(at.join(hot, CELL, "left_anti").groupBy(*CELL).agg(members))
        pending, _ = cut_with(at.join(hot, CELL, "left_semi").drop("lvl", "ci", "cj"))
        lvl += 1
    deepest = lvl
    # Levels above the first are folded from the level below.
    upper = cells[0]
    for up in range(base - 1, -1, -1):
        upper = upper.groupBy(
            "grp", F.lit(up).alias("lvl"),
            F.floor(F.col("ci") / SPLIT).cast("long").alias("ci"),
            F.floor(F.col("cj") / SPLIT).cast("long").alias("cj"),
        ).agg(F.sum("n").alias("n"), *fold).withColumn("leaf", F.lit(False))
        cells.append(upper)
        cell_rows[up] = (SPLIT * SPLIT) ** (up + 1)
    every = cells[0].select(*CELL, "leaf", "n", *[f"{c}{i}" for c in "uvw" for i in (0, 1)])
    for more in cells[1:]:
        every = every.unionByName(more.select(every.columns))
    every, _ = cut_with(every)
    top = F.col("lvl") == 0
    kids = every.groupBy(
        "grp", (F.col("lvl") - 1).alias("lvl"),
        F.when(top, F.lit(0)).otherwise(F.floor(F.col("ci") / SPLIT)).cast("long").alias("pi"),
        F.when(top, F.lit(0)).otherwise(F.floor(F.col("cj") / SPLIT)).cast("long").alias("pj"),
    ).agg(F.collect_list(F.struct(
        "lvl", "ci", "cj", "leaf", "n", *[f"{c}{i}" for c in "uvw" for i in (0, 1)]
    )).alias("kids")).withColumnsRenamed({"pi": "ci", "pj": "cj"})
    inner, inner_seen = cut_with(kids.select(*CELL, "kids"))
    leaves = leaf_parts[0]
    for more in leaf_parts[1:]:
        leaves = leaves.unionByName(more)
    leaves, leaf_seen = cut_with(leaves)
    return TileIndex(metric, k, base, deepest, inner, inner_seen["rows"], leaves, leaf_seen["rows"], every, cell_rows, (p0, q0), span)


def _gap(c: str, lo: Column, hi: Column) -> tuple[Column, Column]:
    near = F.greatest(lo - F.col(c), F.col(c) - hi, F.lit(0.0))
    far = F.greatest(F.abs(F.col(c) - lo), F.abs(F.col(c) - hi))
    return near * near, far * far


def _reach(box) -> tuple[Column, Column]:
    """Least and largest squared distance to what lies in a box."""
    near, far = zip(*[_gap(c, box(f"{c}0"), box(f"{c}1")) for c in "uvw"])
    return near[0] + near[1] + near[2], (far[0] + far[1] + far[2]) * ROUNDING + HAIR


def _bounds(kid: Column) -> Column:
    lo, hi = _reach(lambda c: kid[c])
    return F.struct(
        kid["lvl"].alias("lvl"), kid["ci"].alias("ci"), kid["cj"].alias("cj"), kid["leaf"].alias("leaf"),
        lo.alias("lo"), hi.alias("hi"), kid["n"].alias("n"),
    )


def _kth_bound(tiles: Column, k: int) -> Column:
    """Squared distance within which at least ``k`` targets certainly lie."""
    if k == 1:
        return F.array_min(F.transform(tiles, lambda t: t["hi"]))
    by_far = F.array_sort(F.transform(tiles, lambda t: F.struct(t["hi"].alias("hi"), t["n"].alias("n"))))
    folded = F.aggregate(
        by_far,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("hi")),
        lambda acc, t: F.struct(
            (acc["n"] + t["n"]).alias("n"), F.when(acc["n"] >= k, acc["hi"]).otherwise(t["hi"]).alias("hi")
        ),
    )
    return F.when(folded["n"] >= k, folded["hi"])


def _sides(metric: str) -> tuple[Column, Column, Column]:
    """Half sides of the box that holds all within ``cap``, and whether the
    box neither wraps around the date line nor meets a pole."""
    r = F.sqrt(F.col("cap"))
    if metric != "haversine":
        return r * ROUNDING, r * ROUNDING, F.lit(True)
    angle = F.asin(F.least(r / 2, F.lit(1.0))) * 2 * (1 + 1e-7) + 1e-12
    plain = F.abs(F.radians("qa")) + angle < math.pi / 2
    east = F.degrees(F.asin(F.least(F.sin(angle) / F.cos(F.radians("qa")), F.lit(1.0)))) * (1 + 1e-7)
    return east, F.degrees(angle), plain & F.col("qb").between(F.lit(-180.0) + east, F.lit(180.0) - east)


def _start(walk: DataFrame, index: TileIndex) -> DataFrame:
    """First tiles of every query, with ``cap`` from the deepest tile of at
    least ``k`` targets it lies in; the root where there is none."""
    (p0, q0), metric = index.corner, index.metric
    p, q = (F.col("qa"), F.col("qb")) if metric == "planar" else (F.col("qb"), F.col("qa"))
    plain = walk.columns

    def size(lvl: Column) -> Column:
        return F.lit(index.span) / F.pow(F.lit(float(SPLIT)), lvl + 1)

    mine = walk.withColumns({"_own": F.lit(-1), "_top": F.lit(float("inf"))})
    for lvl in range(index.depth, -1, -1):
        step = index.span / SPLIT ** (lvl + 1)
        at = index.cells.where((F.col("lvl") == lvl) & (F.col("n") >= index.k)).select(
            F.col("grp").alias("_g"), F.col("ci").alias("_i"), F.col("cj").alias("_j"),
            *[F.col(f"{c}{i}") for c in "uvw" for i in (0, 1)])
        at = sized(at, index.cell_rows[lvl])
        on = (F.when(F.col("_own") < 0, F.col("grp")) == F.col("_g")) & (F.floor((p - p0) / step) == F.col("_i")) & (F.floor((q - q0) / step) == F.col("_j"))
        met = mine.join(at, on, "left")
        _, hi = _reach(F.col)
        found = F.col("_g").isNotNull()
        mine = met.select(*plain, F.when(found, F.lit(lvl)).otherwise(F.col("_own")).alias("_own"), F.when(found, hi).otherwise(F.col("_top")).alias("_top"))
    mine = mine.withColumn("cap", F.least("cap", "_top"))
    east, north, whole = _sides(metric)
    few = east <= size(F.col("_own")) * (2 * SPLIT)
    mine = mine.withColumns({"_e": east, "_n": north}).withColumn("_own", F.when(whole & few, F.col("_own")).otherwise(-1))
    # Beside a split tile lie leaves of the levels above.
    mine = mine.withColumn("_at", F.explode(F.sequence(F.least(F.lit(index.base), F.col("_own")), F.col("_own"))))
    root = F.col("_own") < 0
    s = size(F.col("_at"))

    def numbers(v: Column, low: float, half: Column) -> Column:
        first, last = (F.floor((v + w - low) / s).cast("long") for w in (-half, half))
        return F.explode(F.when(root, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last)))

    mine = mine.withColumns({"_ci": numbers(p, p0, F.col("_e"))}).withColumn("_cj", numbers(q, q0, F.col("_n")))
    rows = sum(index.cell_rows.values())
    boxes = index.cells.select(*[F.col(c).alias(f"_{c}") if c != "grp" else F.col(c).alias("_g") for c in CELL], F.col("leaf").alias("_leaf"), F.col("n").alias("_rows"),
                               *[F.col(f"{c}{i}") for c in "uvw" for i in (0, 1)])
    same = (F.col("grp") == F.col("_g")) & (F.col("_at") == F.col("_lvl")) & (F.col("_leaf") | (F.col("_at") == F.col("_own")))
    boxes = boxes.withColumnsRenamed({"_ci": "_i", "_cj": "_j"})
    met = mine.join(sized(boxes, rows), same & (F.col("_ci") == F.col("_i")) & (F.col("_cj") == F.col("_j")), "left")
    lo, hi = _reach(F.col)
    kept = [c for c in plain if c not in ("lvl", "ci", "cj", "leaf", "lo", "hi", "n")]
    return met.where(root | (F.col("_g").isNotNull() & (lo <= F.col("cap")))).select(
        *kept, F.col("_at").alias("lvl"), F.col("_ci").alias("ci"), F.col("_cj").alias("cj"),
        F.when(root, F.lit(False)).otherwise(F.col("_leaf")).alias("leaf"), F.when(root, F.lit(0.0)).otherwise(lo).alias("lo"),
        F.when(root, F.lit(float("inf"))).otherwise(hi).alias("hi"), F.when(root, F.lit(0).cast("long")).otherwise(F.col("_rows")).alias("n"))


def _walked(walk: DataFrame, index: TileIndex, mine) -> DataFrame:
    """Leaves below the tiles of ``walk`` that can hold what is looked for."""
    k = index.k
    # Each step opens cells of one level. The upper levels are small whatever
    # the table's size, so only deep ones can ask for a shuffle.
    at_level = {r["lvl"]: r["n"] for r in index.inner.groupBy("lvl").agg(F.count(F.lit(1)).alias("n")).collect()}
    for step in range(index.depth + 1):
        inner = sized(index.inner.where(F.col("lvl") == step - 1), at_level.get(step - 1, 0) * SPLIT * SPLIT, BROADCAST_ROWS * 4)
        open_ = walk.join(inner, CELL, "left")
        itself = F.array(F.struct("lvl", "ci", "cj", "leaf", "lo", "hi", "n").cast(_CELL_TYPE))
        opened = open_.withColumn(
            "tiles",
            F.coalesce(F.transform("kids", _bounds).cast(f"array<{_CELL_TYPE}>"), itself),
        ).drop("kids")
        opened = opened.withColumn("cap", F.least("cap", _kth_bound(F.col("tiles"), k)))
        walk = opened.select(
            "qid", "grp", "qa", "qb", "u", "v", "w", "far", "cap",
            F.inline(F.filter("tiles", lambda t: t["lo"] <= F.col("cap"))),
        )
        if k == 1:
            best = F.min("hi").over(mine)
        else:
            walk = walk.withColumn("_cum", F.sum("n").over(mine.orderBy("hi")))
            best = F.min(F.when(F.col("_cum") >= k, F.col("hi"))).over(mine)
        walk = walk.withColumn("cap", F.least(F.min("cap").over(mine), best)).drop("_cum")
        walk = walk.where(F.col("lo") <= F.col("cap"))
    return walk


def nearest(
    queries: DataFrame,
    index: TileIndex,
    key: str,
    a: str,
    b: str,
    group: str | None = None,
    max_distance: str | float | None = None,
    prefix: str = "near_",
) -> DataFrame:
    """The ``index.k`` closest targets of every query, ties by target key.

    ``key`` identifies a query (with ``group``). ``max_distance`` is metres
    for haversine, else plain coordinate units. Queries without a target in
    range give no row. The result has ``key``, ``group`` if named,
    ``{prefix}id``, ``{prefix}a``, ``{prefix}b``, ``{prefix}rank`` and
    ``distance``.
    """
    metric, k = index.metric, index.k
    ca, cb = F.col(a).cast("double"), F.col(b).cast("double")
    u, v, w = _place(metric, ca, cb)
    if max_distance is None:
        limit = far = F.lit(float("inf"))
    else:
        far = reach = F.col(max_distance) if isinstance(max_distance, str) else F.lit(float(max_distance))
        reach = geo.chord_of_m(reach) if metric == "haversine" else reach
        limit = reach * reach * F.lit(ROUNDING) + F.lit(1e-300)
    walk = queries.where(ca.isNotNull() & cb.isNotNull()).select(
        F.col(key).alias("qid"),
        (F.col(group) if group else F.lit(0)).cast("long").alias("grp"),
        ca.alias("qa"), cb.alias("qb"), u.alias("u"), v.alias("v"), w.alias("w"), far.cast("double").alias("far"),
        limit.cast("double").alias("cap"),
        F.lit(-1).alias("lvl"), F.lit(0).cast("long").alias("ci"), F.lit(0).cast("long").alias("cj"),
        F.lit(False).alias("leaf"), F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"),
        F.lit(0).cast("long").alias("n"),
    )
    places = ["u", "v", "w"]
    # A small file of queries is one task's input; the search costs far more than reading it.
    walk = walk.repartition(int(walk.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    begun, seen = cut_with(_start(walk, index).drop(*places), open=F.sum(F.when(~F.col("leaf"), 1).otherwise(0)))
    begun = begun.withColumns(dict(zip(places, _place(metric, F.col("qa"), F.col("qb")))))
    mine = W.partitionBy("qid", "grp")
    walk = begun.where("leaf")
    if seen["open"]:
        walk = walk.unionByName(_walked(begun.where("not leaf"), index, mine).select(walk.columns))

    def offset(m: Column) -> Column:
        du, dv, dw = m["u"] - F.col("u"), m["v"] - F.col("v"), m["w"] - F.col("w")
        return du * du + dv * dv + dw * dw

    leaves = sized(index.leaves, index.leaf_rows * 16)
    hits = walk.select("qid", "grp", "qa", "qb", "u", "v", "w", "far", "cap", "lvl", "ci", "cj").join(leaves, CELL)
    # Squared chords only sort out what is near; the metric's own distance
    # ranks. The edge is a column of its own, so it is not found per member.
    offsets = F.transform("members", offset)
    kth = F.array_min(offsets) if k == 1 else F.coalesce(F.get(F.array_sort(offsets), F.lit(k - 1)), F.lit(float("inf")))
    near = hits.withColumn("_edge", F.least(F.col("cap"), kth * ROUNDING + HAIR))

    def ranked(m: Column) -> Column:
        d = geo.haversine_m("qa", "qb", m["a"], m["b"]) if metric == "haversine" else offset(m)
        return F.struct(d.alias("d"), m["id"].alias("id"), m["a"].alias("a"), m["b"].alias("b"))

    scored = F.transform(F.filter("members", lambda m: offset(m) <= F.col("_edge")), ranked)
    found = near.select("qid", "grp", "qa", "qb", "far", F.explode(scored).alias("hit"))
    if k == 1:
        found = found.groupBy("qid", "grp").agg(
            F.first("qa").alias("qa"), F.first("qb").alias("qb"), F.first("far").alias("far"), F.min("hit").alias("hit")
        ).withColumn("rank", F.lit(1))
    else:
        found = found.withColumn("rank", F.row_number().over(mine.orderBy("hit"))).where(F.col("rank") <= k)
    if metric == "planar":
        distance = F.sqrt(F.col("hit.d"))
    elif metric == "haversine":
        distance = F.col("hit.d")
    else:
        distance = geo.haversine_m("qa", "qb", F.col("hit.a"), F.col("hit.b"))
    out = found.withColumn("distance", distance).where(F.col("distance") <= F.col("far"))
    return out.select(
        F.col("qid").alias(key), *([F.col("grp").alias(group)] if group else []),
        F.col("hit.id").alias(f"{prefix}id"), F.col("hit.a").alias(f"{prefix}a"),
        F.col("hit.b").alias(f"{prefix}b"), F.col("rank").alias(f"{prefix}rank"), "distance",
    )
