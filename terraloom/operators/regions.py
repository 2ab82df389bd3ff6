"""Point-in-region joins over polygons with holes, several parts, overlaps.

A region set is turned into a cover: one row per grid cell, listing for each
region whether the whole cell is inside, or else the few edges that pass
through the cell and the state of the cell's lower right corner. A point then
needs one equi join on its own cell: from the point to that corner it counts
edges crossed, and each crossing flips inside and outside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..scratch import cut_with, sized

REGION_SCHEMA = (
    "code string, country_code string, name_latn string, "
    "polygons array<array<array<struct<x:double,y:double>>>>"
)
#: Cells of this size are not split: their edges meet in one point.
SMALLEST_M = 0.05
_EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"


@dataclass
class Level:
    """Cells of one size. A cell with null ``regions`` is split in the next."""

    cells: DataFrame
    rows: int
    edges: int
    cell_m: float


@dataclass
class RegionCover:
    levels: list[Level]

    @property
    def rows(self) -> int:
        return sum(x.rows for x in self.levels)

    @property
    def cell_m(self) -> float:
        """Size of the smallest cells."""
        return self.levels[-1].cell_m


def region_edges(regions: DataFrame) -> DataFrame:
    """(code, x1, y1, x2, y2) per polygon edge; open rings are closed."""
    rings = regions.select("code", F.explode("polygons").alias("_p")).select("code", F.explode("_p").alias("r"))
    n = F.size("r")
    closed = F.when((n > 0) & (F.col("r")[0] != F.element_at("r", -1)), F.concat("r", F.slice("r", 1, 1)))
    rings = rings.where(n > 2).select("code", F.coalesce(closed, F.col("r")).alias("r"))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("r") - 1),
        lambda i: F.struct(
            F.element_at("r", i)["x"].alias("x1"), F.element_at("r", i)["y"].alias("y1"),
            F.element_at("r", i + 1)["x"].alias("x2"), F.element_at("r", i + 1)["y"].alias("y2"),
        ),
    )
    edges = rings.select("code", F.inline(steps))
    return edges.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _cells_of_edges(edges: DataFrame, c: float) -> DataFrame:
    """Edges repeated for every cell they touch, with a hair of margin."""
    slack = 1e-6
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn(
        "cy", F.explode(F.sequence(F.floor(lo / c - slack).cast("long"), F.floor(hi / c + slack).cast("long")))
    )
    def x_at(y: Column) -> Column:
        y = F.least(F.greatest(y, lo), hi)
        t = (y - F.col("y1")) / (F.col("y2") - F.col("y1"))
        return F.col("x1") + t * (F.col("x2") - F.col("x1"))
    flat = F.col("y1") == F.col("y2")
    xa = F.when(flat, F.col("x1")).otherwise(x_at(F.col("cy") * c - slack * c))
    xb = F.when(flat, F.col("x2")).otherwise(x_at((F.col("cy") + 1) * c + slack * c))
    rows = rows.withColumn("_xa", F.least(xa, xb)).withColumn("_xb", F.greatest(xa, xb))
    return rows.withColumn("cx", F.explode(F.sequence(
        F.floor(F.col("_xa") / c - slack).cast("long"), F.floor(F.col("_xb") / c + slack).cast("long")
    ))).drop("_xa", "_xb")


def _parities(marks: DataFrame, edges: DataFrame, c: float) -> DataFrame:
    """``marks`` (code, cx, cy, ...) with the state of each cell's lower right
    corner: the edges of its region that cross the row line right of it."""
    first = F.ceil(F.least("y1", "y2") / c).cast("long")
    last = (F.ceil(F.greatest("y1", "y2") / c) - 1).cast("long")
    lines = edges.where(first <= last).withColumn("cy", F.explode(F.sequence(first, last)))
    y = F.col("cy") * c
    at = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    # Crossings count for all cells left of them.
    crossings = lines.groupBy("code", "cy", (F.ceil(at / c) - 2).cast("long").alias("cx")).agg(F.count(F.lit(1)).alias("n"))
    # One window row per occupied cell of a region's grid row.
    row = W.partitionBy("code", "cy").orderBy(F.desc("cx"))
    both = crossings.withColumn("mark", F.lit(False)).unionByName(
        marks.withColumn("n", F.lit(0).cast("long")).withColumn("mark", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("parity", (F.sum("n").over(row) % 2).cast("int")).withColumn("next", F.lead("cx").over(row))


def _crowded(touched: DataFrame, c: float, max_edges: int) -> tuple[DataFrame, int]:
    """Cells of more than ``max_edges`` edges, unless they are the smallest."""
    busy = touched.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > max_edges) & F.lit(c / 2 >= SMALLEST_M))
    cells, seen = cut_with(busy.select("cx", "cy"))
    return cells, seen["rows"]


def _level(border: DataFrame, plain: DataFrame, busy: DataFrame, c: float) -> Level:
    """Rows per cell from border rows and wholly covered ones."""
    rows = border.select("code", "cx", "cy", F.lit(False).alias("inside"), "parity", "edges").unionByName(plain.select(
        "code", "cx", "cy", F.lit(True).alias("inside"), F.lit(1).alias("parity"), F.array().cast(f"array<{_EDGE}>").alias("edges")))
    cells = rows.groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.struct("code", "inside", "parity", "edges"))).alias("regions"))
    cells = cells.unionByName(busy.withColumn("regions", F.lit(None).cast(cells.schema["regions"].dataType)))
    cells, seen = cut_with(cells, edges=F.sum(F.aggregate("regions", F.lit(0), lambda a, r: a + F.size(r["edges"]))))
    return Level(cells, seen["rows"], seen["edges"] or 0, c)


def build_cover(regions: DataFrame, cell_m: float = 20_000.0, max_edges: int = 512) -> RegionCover:
    """Cover of a region set in Web-Mercator metres.

    A cell with more than ``max_edges`` edges is split into four, level by
    level, until none is crowded; all other cells keep their size.
    """
    edges, _ = cut_with(region_edges(regions))
    touched, _ = cut_with(_cells_of_edges(edges, cell_m))
    busy, n_busy = _crowded(touched, cell_m, max_edges)
    border = touched.groupBy("code", "cx", "cy").agg(F.count(F.lit(1)).alias("k"))
    listed = touched.join(busy, ["cx", "cy"], "left_anti").groupBy("code", "cx", "cy").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    marks, _ = cut_with(_parities(listed, edges, cell_m))
    # Inside runs between crossings, without the cells an edge passes.
    row = W.partitionBy("code", "cy").orderBy(F.desc("cx"))
    turns = marks.where(~F.col("mark")).withColumn("next", F.lead("cx").over(row))
    runs = turns.where((F.col("parity") == 1) & F.col("next").isNotNull() & (F.col("next") < F.col("cx")))
    filled, _ = cut_with(runs.select("code", "cy", F.explode(F.sequence(F.col("next") + 1, F.col("cx"))).alias("cx")).join(
        border, ["code", "cx", "cy"], "left_anti"))
    plain = filled.join(busy, ["cx", "cy"], "left_anti")
    levels = [_level(marks.where("mark"), plain, busy, cell_m)]
    # Regions that have something of a split cell: by an edge, or all of it.
    part = border.select("code", "cx", "cy").unionByName(filled.select("code", "cx", "cy")).join(busy, ["cx", "cy"], "left_semi")
    near = touched.join(busy, ["cx", "cy"], "left_semi")
    c = cell_m
    while n_busy:
        c /= 2
        quarter = F.explode(F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)]))
        wanted, _ = cut_with(part.select("code", quarter.alias("q")).select("code", "q.cx", "q.cy"))
        spots = wanted.select("cx", "cy").distinct()
        inner = near.select("code", "x1", "y1", "x2", "y2").distinct()
        near, _ = cut_with(_cells_of_edges(inner, c).join(spots, ["cx", "cy"], "left_semi"))
        busy, n_busy = _crowded(near, c, max_edges)
        listed = near.join(busy, ["cx", "cy"], "left_anti").groupBy("code", "cx", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        passed = near.select("code", "cx", "cy").distinct().withColumn("passed", F.lit(True))
        asked = wanted.join(passed, ["code", "cx", "cy"], "left").join(listed, ["code", "cx", "cy"], "left")
        # Only the grid rows of split cells are looked at.
        rows = wanted.select("code", F.col("cy").alias("_cy")).distinct()
        span = rows.groupBy("code").agg(F.min("_cy").alias("lo"), F.max("_cy").alias("hi"))
        some = edges.join(span, "code").where((F.least("y1", "y2") <= (F.col("hi") + 1) * c) & (F.greatest("y1", "y2") >= F.col("lo") * c))
        marks, _ = cut_with(_parities(asked, some.select("code", "x1", "y1", "x2", "y2"), c).where("mark"))
        whole = marks.where("passed is null and parity = 1").select("code", "cx", "cy")
        levels.append(_level(marks.where("edges is not null"), whole.join(busy, ["cx", "cy"], "left_anti"), busy, c))
        part = marks.where("passed or parity = 1").select("code", "cx", "cy").join(busy, ["cx", "cy"], "left_semi")
        near = near.join(busy, ["cx", "cy"], "left_semi")
    return RegionCover(levels)


def _touches(e: Column, x: Column, y: Column) -> Column:
    line = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
    return (
        (line == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def region_matches(regions: Column, x: Column, y: Column, cx: Column, cy: Column, c: float, predicate: str) -> Column:
    """Codes of the cell's regions that hold the point, in code order."""
    xr, yr = (cx + 1) * F.lit(c), cy * F.lit(c)

    def flips(e: Column) -> Column:
        across = e["x1"] + (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (e["x2"] - e["x1"])
        level = ((e["y1"] <= y) != (e["y2"] <= y)) & (across > x) & (across <= xr)
        down = e["y1"] + (xr - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) * (e["y2"] - e["y1"])
        drop = ((e["x1"] <= xr) != (e["x2"] <= xr)) & (down > yr) & (down <= y)
        return F.when(level, 1).otherwise(0) + F.when(drop, 1).otherwise(0)

    def holds(r: Column) -> Column:
        odd = F.aggregate(r["edges"], r["parity"], lambda acc, e: acc + flips(e)) % 2 == 1
        edge = F.exists(r["edges"], lambda e: _touches(e, x, y))
        real = odd | edge if predicate == "covers" else odd & ~edge
        return r["inside"] | real

    return F.transform(F.filter(regions, holds), lambda r: r["code"])


def assign_regions(
    points: DataFrame,
    cover: RegionCover,
    lat: str = "lat",
    lon: str = "lon",
    predicate: str = "covers",
    multi: bool = False,
    name: str = "region",
    how: str = "left",
) -> DataFrame:
    """Tag points with the region that holds them.

    ``covers`` counts border points as inside, ``within`` does not. A point
    in several regions gets the smallest code, or one row per region with
    ``multi``. ``how`` is ``left`` (unmatched stay, null) or ``inner``.
    """
    if predicate not in ("covers", "within"):
        raise ValueError(f"unknown predicate {predicate!r}")
    x, y = geo.mercator_x(lon), geo.mercator_y(lat)
    met = points.withColumn("_x", x).withColumn("_y", y)
    codes = F.lit(None).cast("array<string>")
    for k, level in enumerate(cover.levels):
        c = level.cell_m
        # Only points of a split cell go on to the next level.
        go_on = F.lit(True) if k == 0 else F.col(f"_cx{k - 1}").isNotNull() & F.col(f"_hit{k - 1}") & F.col(f"_r{k - 1}").isNull()
        met = met.withColumn(f"_cx{k}", F.when(go_on, F.floor(F.col("_x") / c).cast("long"))).withColumn(
            f"_cy{k}", F.when(go_on, F.floor(F.col("_y") / c).cast("long")))
        # Edges weigh more than rows, so both counts must be small to broadcast.
        cells = sized(level.cells.select(F.col("cx").alias("_x1"), F.col("cy").alias("_y1"), F.col("regions").alias(f"_r{k}"), F.lit(True).alias(f"_hit{k}")),
                      level.rows + 8 * level.edges)
        met = met.join(cells, (F.col(f"_cx{k}") == F.col("_x1")) & (F.col(f"_cy{k}") == F.col("_y1")), how if k == 0 else "left").drop("_x1", "_y1")
        here = region_matches(F.col(f"_r{k}"), F.col("_x"), F.col("_y"), F.col(f"_cx{k}"), F.col(f"_cy{k}"), c, predicate)
        codes = here if k == 0 else F.when(F.col(f"_r{k}").isNotNull(), here).otherwise(codes)
    # A generator keeps later filters above it, so a point is tested once.
    code = F.explode_outer(codes if multi else F.slice(codes, 1, 1))
    out = met.select(*points.columns, code.alias(name))
    return out.where(F.col(name).isNotNull()) if how == "inner" else out


def require_codes(regions: DataFrame, codes: list[str]) -> tuple[list[str], list[str]]:
    """Split the asked-for codes into known and unknown ones."""
    asked = regions.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    missing = {r[0] for r in asked.join(regions.select("code"), "code", "left_anti").collect()}
    return [c for c in codes if c not in missing], sorted(missing)


def points_in_regions(
    points: DataFrame, regions: DataFrame, codes: list[str], predicate: str = "within", **kw
) -> tuple[DataFrame, list[str]]:
    """Inner join to several regions, and the codes no region has.

    Unknown codes alone are an error. ``predicate`` is that of ``assign_regions``.
    """
    known, missing = require_codes(regions, codes)
    if not known:
        raise ValueError(f"no region found among {missing}")
    cover = build_cover(regions.where(F.col("code").isin(known)))
    return assign_regions(points, cover, how="inner", multi=True, predicate=predicate, **kw), missing


def points_in_region(points: DataFrame, regions: DataFrame, code: str, **kw) -> DataFrame:
    known, _ = require_codes(regions, [code])
    if not known:
        raise ValueError(f"region {code} not found")
    cover = build_cover(regions.where(F.col("code") == code))
    return assign_regions(points, cover, how="inner", predicate="within", **kw)


def points_in_polygon(points: DataFrame, shape: DataFrame, **kw) -> DataFrame:
    """Points inside one ad-hoc region; ``shape`` must hold exactly one row."""
    count = shape.limit(2).count()
    if count != 1:
        raise ValueError("exactly one polygon is expected")
    cover = build_cover(shape.withColumn("code", F.lit("shape")))
    return assign_regions(points, cover, how="inner", predicate="within", **kw).drop(kw.get("name", "region"))


def combine_regions(r2024: DataFrame, r2021: DataFrame) -> DataFrame:
    """Level-2 regions of the newer set plus the older set's United Kingdom."""
    uk = F.upper(F.col("country_code")).isin("UK", "GB")
    return level_two(r2024).unionByName(level_two(r2021).where(uk))


def level_two(regions: DataFrame, level: str = "level") -> DataFrame:
    """Rows of level 2; without levels, codes of four characters."""
    if level in regions.columns:
        return regions.where(F.col(level) == 2)
    return regions.where(F.length("code") == 4)


def region_dimension(regions: DataFrame) -> DataFrame:
    """Distinct regions with all three properties set; the first row wins."""
    whole = regions.where(
        F.col("code").isNotNull() & F.col("country_code").isNotNull() & F.col("name_latn").isNotNull()
    )
    return whole.groupBy("code").agg(
        F.min(F.struct("country_code", "name_latn")).alias("_r")
    ).select("code", "_r.country_code", "_r.name_latn")
