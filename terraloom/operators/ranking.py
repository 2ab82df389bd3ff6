"""Positions in a total order, without one task holding a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import cut, cut_with, sized


def dense_positions(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    name: str = "position",
    start: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Number rows ``start, start+1, ...`` in ``order`` within each ``group``.

    ``order`` must be total. Rows are range-partitioned on (group, order), so
    a group holding most of the table still spreads over many tasks; each
    slice is numbered on its own and shifted by the sizes of earlier slices.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    # Written once: the range bounds are sampled and must not be drawn twice.
    placed = cut(df.repartitionByRange(n, *keys, *order).withColumn("_pos_slice", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "_pos_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = before.orderBy("_pos_slice").rowsBetween(W.unboundedPreceding, -1)
    # One row per group and slice; without groups at most ``n`` rows.
    shift = sizes.select(*group, "_pos_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pos_shift"))
    if not group:
        shift = F.broadcast(shift)
    inner = W.partitionBy(*group, "_pos_slice").orderBy(*order)
    return (
        placed.withColumn("_pos_at", F.row_number().over(inner))
        .join(shift, [*group, "_pos_slice"])
        .withColumn(name, F.col("_pos_at") + F.col("_pos_shift") + F.lit(start - 1))
        .drop("_pos_slice", "_pos_at", "_pos_shift")
    )


def top_n_rest(df: DataFrame, key: str, value: str, n: int = 20, rest: str = "(other)") -> DataFrame:
    """The ``n`` largest keys by value, and one row summing all others.

    ``df`` has one row per key. Ties go to the smaller key.
    """
    top = df.orderBy(F.desc(value), F.asc(key)).limit(n).select(F.col(key).alias("_top"))
    named = F.when(F.col("_top").isNotNull(), F.col(key).cast("string")).otherwise(F.lit(rest))
    return (
        df.join(F.broadcast(top), F.col(key) == F.col("_top"), "left")
        .groupBy(named.alias(key))
        .agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("keys"))
    )


def pick_one(
    df: DataFrame, requests: DataFrame, key: str, request: str, draw, seed: int = 0
) -> DataFrame:
    """One uniform row of ``df`` per request.

    ``draw(column, seed)`` gives a number in [0, 1). Rows get positions in
    key order and each request joins the position it drew.
    """
    numbered, seen = cut_with(dense_positions(df, [F.col(key)], name="_pos"))
    total = seen["rows"]
    if total == 0:
        return requests.join(df.limit(0), F.lit(False), "left")
    drawn = requests.withColumn("_pos", F.floor(draw(request, seed) * F.lit(total)).cast("long"))
    return drawn.join(sized(numbered, total), "_pos").drop("_pos")


def running_sum(
    df: DataFrame, value: str, order: Sequence[Column], group: Sequence[str], name: str = "running",
    partitions: int | None = None,
) -> DataFrame:
    """Running total of ``value`` in ``order`` within each ``group``.

    Slices are summed on their own and shifted, as in ``dense_positions``.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    placed = cut(df.repartitionByRange(n, *keys, *order).withColumn("_pos_slice", F.spark_partition_id()))
    before = W.partitionBy(*group).orderBy("_pos_slice").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_pos_slice").agg(F.sum(value).alias("_s"))
    shift = sums.select(*group, "_pos_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_pos_shift"))
    inner = W.partitionBy(*group, "_pos_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.withColumn("_in", F.sum(value).over(inner)).join(shift, [*group, "_pos_slice"])
        .withColumn(name, F.col("_in") + F.col("_pos_shift")).drop("_pos_slice", "_in", "_pos_shift")
    )
