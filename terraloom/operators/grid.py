"""Uniform latitude/longitude grids, web-map tiles and density figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def bbox(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row: north, south, east, west and the number of points."""
    return df.agg(
        F.max(lat).alias("north"), F.min(lat).alias("south"),
        F.max(lon).alias("east"), F.min(lon).alias("west"), F.count(F.lit(1)).alias("points"),
    )


def grid_of(box: DataFrame, cell_km: float) -> DataFrame:
    """One row describing a grid over ``box``: degree steps and dimensions.

    Steps are what ``cell_km`` spans due north and due east at mid-latitude.
    """
    if cell_km <= 0:
        raise ValueError("cell size must be positive")
    bad = (
        (F.col("north") <= F.col("south")) | (F.col("east") <= F.col("west"))
        | (F.col("north") > 90) | (F.col("south") < -90) | (F.col("east") > 180) | (F.col("west") < -180)
    )
    mid = (F.col("north") + F.col("south")) / 2
    out = box.select("north", "south", "east", "west").withColumn(
        "north", F.when(bad, F.raise_error(F.lit("not a usable bounding box")).cast("double")).otherwise(F.col("north"))
    )
    out = out.withColumn("dlat", F.lit(math.degrees(cell_km / geo.GEODESIC_RADIUS_KM)))
    out = out.withColumn("dlon", geo.east_degrees(mid, cell_km))
    out = out.withColumn("width", F.ceil((F.col("east") - F.col("west")) / F.col("dlon")).cast("long"))
    out = out.withColumn("height", F.ceil((F.col("north") - F.col("south")) / F.col("dlat")).cast("long"))
    return out.withColumn("total_cells", F.col("width") * F.col("height"))


def _scalar(grid: DataFrame) -> Column:
    return grid.select(F.struct("*")).scalar()


def with_cell(df: DataFrame, grid: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``cell_x, cell_y`` counted from the north-west; outside is dropped."""
    g = _scalar(grid)
    inside = F.col(lat).between(g["south"], g["north"]) & F.col(lon).between(g["west"], g["east"])
    return df.where(inside).withColumn(
        "cell_x", F.floor((F.col(lon) - g["west"]) / g["dlon"]).cast("long")
    ).withColumn("cell_y", F.floor((g["north"] - F.col(lat)) / g["dlat"]).cast("long"))


def cell_bounds(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Bounds of each cell cut to the grid's box, its centre, and validity."""
    g = _scalar(grid)
    x, y = F.col("cell_x"), F.col("cell_y")
    out = cells.withColumn("cell_west", F.greatest(g["west"] + x * g["dlon"], g["west"]))
    out = out.withColumn("cell_east", F.least(g["west"] + (x + 1) * g["dlon"], g["east"]))
    out = out.withColumn("cell_north", F.least(g["north"] - y * g["dlat"], g["north"]))
    out = out.withColumn("cell_south", F.greatest(g["north"] - (y + 1) * g["dlat"], g["south"]))
    out = out.withColumn("center_lat", (F.col("cell_north") + F.col("cell_south")) / 2)
    out = out.withColumn("center_lon", (F.col("cell_east") + F.col("cell_west")) / 2)
    return out.withColumn("valid", (x >= 0) & (x < g["width"]) & (y >= 0) & (y < g["height"]))


def neighbors(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """The up to eight valid cells around each cell."""
    g = _scalar(grid)
    around = F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
        for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy
    ])
    out = cells.select("cell_x", "cell_y", F.inline(around))
    out = out.withColumn("near_x", F.col("cell_x") + F.col("dx")).withColumn("near_y", F.col("cell_y") + F.col("dy"))
    ok = F.col("near_x").between(0, g["width"] - 1) & F.col("near_y").between(0, g["height"] - 1)
    return out.where(ok).drop("dx", "dy")


def cells_in_bbox(boxes: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells meeting each row's ``b_north, b_south, b_east, b_west``."""
    g = _scalar(grid)
    n, s = F.least("b_north", g["north"]), F.greatest("b_south", g["south"])
    e, w = F.least("b_east", g["east"]), F.greatest("b_west", g["west"])
    hit = boxes.where((n > s) & (e > w))
    def top(v: Column, limit: Column) -> Column:
        return F.least(F.floor(v).cast("long"), limit - 1)
    xs = F.sequence(F.floor((w - g["west"]) / g["dlon"]).cast("long"), top((e - g["west"]) / g["dlon"], g["width"]))
    ys = F.sequence(F.floor((g["north"] - n) / g["dlat"]).cast("long"), top((g["north"] - s) / g["dlat"], g["height"]))
    return hit.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))


def cell_density(df: DataFrame, grid: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points per occupied cell with the cell's centre."""
    counts = with_cell(df, grid, lat, lon).groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("points"))
    return cell_bounds(counts, grid).select("cell_x", "cell_y", "points", "center_lat", "center_lon")


def density_stats(cells: DataFrame, grid: DataFrame | None = None, col: str = "points") -> DataFrame:
    """Distribution of the per-cell counts; the deviation is the population's."""
    # Counts repeat a lot, so the median is taken over (value, frequency).
    freq = cells.groupBy(F.col(col).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    mean = F.sum(F.col("v") * F.col("w")) / F.sum("w")
    square = F.sum(F.col("v").cast("double") * F.col("v") * F.col("w")) / F.sum("w")
    out = freq.agg(
        F.min("v").alias("min"), F.max("v").alias("max"), mean.alias("mean"),
        F.percentile("v", F.lit(0.5), F.col("w")).alias("median"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"),
        F.sum(F.col("v") * F.col("w")).alias("total"), F.sum("w").alias("occupied_cells"),
    )
    if grid is not None:
        out = out.withColumn("total_cells", grid.select("total_cells").scalar())
    return out


def histogram(df: DataFrame, col: str = "points") -> DataFrame:
    """Counts in clamp(floor(sqrt(n)), 5, 20) bins; equal values give one bin.

    Bins without rows are listed with 0.
    """
    stats = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n"))
    stats = stats.withColumn(
        "bins", F.least(F.greatest(F.floor(F.sqrt("n")), F.lit(5)), F.lit(20)).cast("long")
    ).withColumn("width", F.ceil((F.col("hi") - F.col("lo")) / F.col("bins")).cast("long"))
    stats = stats.withColumn("bins", F.when(F.col("width") == 0, F.lit(1)).otherwise(F.col("bins")).cast("long"))
    s = _scalar(stats)
    bin_no = F.when(s["width"] == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - s["lo"]) / F.greatest(s["width"], F.lit(1))), s["bins"] - 1)
    ).cast("long")
    filled = df.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    # At most 20 rows.
    frame = stats.where(F.col("n") > 0).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin")
    )
    upper = F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(
        F.col("lo") + (F.col("bin") + 1) * F.col("width") - 1
    )
    return frame.join(filled, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("from"), upper.alias("to"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def with_tile(df: DataFrame, zoom: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Web-map tile ``tile_x, tile_y`` of each point at ``zoom``."""
    n = 2 ** zoom
    half = math.pi * geo.MERCATOR_RADIUS_M
    def clamp(v: Column) -> Column:
        return F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("long")
    return df.withColumn("tile_z", F.lit(zoom)).withColumn(
        "tile_x", clamp((geo.mercator_x(lon) + half) / (2 * half) * n)
    ).withColumn("tile_y", clamp((half - geo.mercator_y(lat)) / (2 * half) * n))
