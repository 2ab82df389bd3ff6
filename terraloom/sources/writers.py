"""Sinks: regional and flat Parquet, compressed CSV, appends and upserts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import geo
from ..functions.hashing import unit_hash
from ..scratch import cut, cut_with

FLAT_ROW_GROUP = 250_000
#: Rows that one task of a regional write sorts at most, about.
TASK_ROWS = 5_000_000
ROW_GROUP_BYTES = 16 << 20


def write_by_region(
    df: DataFrame, path: str, region: str = "region", rows_per_file: int = 5_000_000, lat: str = "lat", lon: str = "lon",
) -> DataFrame:
    """Parquet partitioned by region; returns rows written per region.

    Rows without region are left out. Within a region rows follow a
    space-filling curve over ``lat`` and ``lon`` (where the table has them),
    so files and row groups cover small boxes and a box read skips most. Rows
    are dealt out by range, so one large region is not one task and rows of
    one place still spread. A task writes many files where they are short:
    tasks follow the cluster and the rows, not the files.
    """
    kept = df.where(F.col(region).isNotNull())
    counts, seen = cut_with(kept.groupBy(region).agg(F.count(F.lit(1)).alias("rows")), total=F.sum("rows"))
    total = seen["total"] or 0
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-total // rows_per_file), max(n, -(-total // TASK_ROWS))))
    cols = [F.col(c) for c in df.columns if c != region]
    place = [F.coalesce(geo.morton(*geo.morton_xy(lat, lon)), F.lit(-1)).alias("_z")] if {lat, lon} <= set(df.columns) else []
    keyed = kept.select("*", *place, unit_hash(cols, 0).alias("_tie"))
    order = [region, *(["_z"] if place else []), "_tie"]
    (keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_z", "_tie").write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(region).parquet(path))
    return counts


def read_box(
    spark: SparkSession, path: str, code: str, south: float, west: float, north: float, east: float,
    region: str = "region", lat: str = "lat", lon: str = "lon",
) -> DataFrame:
    """One region's rows in a box, bounds inclusive; row groups whose
    coordinates lie outside of it are not read."""
    return read_region(spark, path, code, region).where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def read_region(spark: SparkSession, path: str, code: str, region: str = "region") -> DataFrame:
    """One region's rows by partition pruning; an unknown region is an error."""
    df = spark.read.parquet(path).where(F.col(region) == code)
    if df.limit(1).isEmpty():
        raise ValueError(f"region {code} not found in {path}")
    return df


def write_flat(df: DataFrame, path: str) -> None:
    """Plain snappy Parquet with dictionary pages, in bounded files."""
    (df.write.mode("overwrite").option("compression", "snappy").option("parquet.enable.dictionary", "true")
     .option("maxRecordsPerFile", FLAT_ROW_GROUP * 20).parquet(path))


def write_csv_gz(df: DataFrame, path: str, decimals: int | None = 7) -> None:
    """Gzip CSV with header; coordinates with fixed decimals."""
    out = df
    if decimals is not None:
        for c, kind in df.dtypes:
            if kind == "double":
                out = out.withColumn(c, F.format_string(f"%.{decimals}f", F.col(c)))
    out.write.mode("overwrite").option("header", True).option("compression", "gzip").option("quote", '"').option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Small report as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _replace(df: DataFrame, path: str) -> None:
    """Store ``df`` in place of the table at ``path``: written beside it first,
    so the old table stays until the new one is whole."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    df.write.parquet(fresh)
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = named(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(named(path)) and not files.rename(named(path), named(old)):
        raise RuntimeError(f"{path} can't be set aside")
    if not files.rename(named(fresh), named(path)):
        files.rename(named(old), named(path))
        raise RuntimeError(f"{fresh} can't take the place of {path}")
    files.delete(named(old), True)
    spark.catalog.refreshByPath(path)


def new_rows(df: DataFrame, target: DataFrame | None, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key the target lacks, the first one per key."""
    first = W.partitionBy(key).orderBy(*([order] if order else [c for c in df.columns if c != key]))
    picked = df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return picked if target is None else picked.join(target.select(key), key, "left_anti").select(*df.columns)


def append_new(df: DataFrame, path: str, key: str, order: str | None = None) -> int:
    """Append the rows whose key is not yet stored; returns how many."""
    fresh = cut(new_rows(df, _existing(df.sparkSession, path), key, order))
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def upserted(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Target rows replaced by ``df`` where keys meet, plus new ones."""
    return target.join(df.select(key), key, "left_anti").select(*df.columns).unionByName(df)


def upsert_counts(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row: keys inserted, updated (some column differs), unchanged."""
    rest = [c for c in df.columns if c != key]
    old = target.select(key, F.struct(*rest).alias("_old"))
    met = df.select(key, F.struct(*rest).alias("_new")).join(old, key, "left")
    new = F.col("_old").isNull()
    same = F.col("_old").eqNullSafe(F.col("_new"))
    def n(c):
        return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return met.agg(n(new).alias("inserted"), n(~new & ~same).alias("updated"), n(~new & same).alias("unchanged"))


def upsert(df: DataFrame, path: str, key: str) -> dict:
    """Upsert ``df`` (one row per key) into a stored dimension."""
    spark = df.sparkSession
    target = _existing(spark, path)
    if target is None:
        _replace(df, path)
        return {"inserted": df.count(), "updated": 0, "unchanged": 0}
    target = cut(target)
    counts = upsert_counts(df, target, key).first().asDict()
    _replace(upserted(df, target, key), path)
    return counts


def reload(df: DataFrame, path: str) -> DataFrame:
    """Replace the stored table and check the row count that was written."""
    spark = df.sparkSession
    kept = cut(df)
    _replace(kept, path)
    stored = spark.read.parquet(path)
    if stored.count() != kept.count():
        raise RuntimeError(f"{path} holds other rows than were written")
    return stored


def truncate(spark: SparkSession, path: str) -> None:
    """Empty a stored table, keeping its columns, and check that it is."""
    df = _existing(spark, path)
    if df is None:
        return
    _replace(spark.createDataFrame([], df.schema), path)
    if not spark.read.schema(df.schema).parquet(path).isEmpty():
        raise RuntimeError(f"{path} is not empty")


def write_generated(jobs: DataFrame, rejects: DataFrame, folder: str, mode: str = "missing") -> None:
    """Jobs and rejected addresses with reasons, side by side."""
    for name, df in (("jobs", jobs), ("rejects", rejects)):
        path = os.path.join(folder, name)
        if mode == "all":
            _replace(df, path)
        else:
            df.write.mode("append").parquet(path)
