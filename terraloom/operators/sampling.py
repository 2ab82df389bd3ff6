"""Samplers driven by a seeded hash of the key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..scratch import cut_with, sized

# Regions left out of address sampling by default.
EXCLUDED_REGIONS = ["ES63", "ES64"]
DEFAULT_REGION_CAP = 1000
# Route length ranges in km per job tier.
TIER_RANGES_KM = {
    1: (0.1, 0.6), 2: (0.25, 1.5), 3: (0.6, 4.0), 4: (1.5, 10.0),
    5: (4.0, 25.0), 6: (10.0, 60.0), 7: (25.0, 150.0), 8: (60.0, 950.0),
}
MAX_TIER = 8
TIER_TEMPERATURE = 2.0
# Job categories with the lowest tier they occur in.
CATEGORY_MIN_TIER = {
    "GROCERIES": 1, "PACKAGES": 1, "FOOD": 2, "FURNITURE": 3, "PEOPLE": 4,
    "FRAGILE_GOODS": 5, "CONSTRUCTION": 6, "LIQUIDS": 7, "TOXIC_GOODS": 8,
}


def sample_per_region(
    df: DataFrame,
    counts: DataFrame | None = None,
    cap: int = DEFAULT_REGION_CAP,
    seed: int = 0,
    exclude: Sequence[str] = tuple(EXCLUDED_REGIONS),
    key: str = "id",
    region: str = "region",
    method: str = "xx",
) -> DataFrame:
    """Keep each row with probability min(1, cap / rows of its region).

    ``counts(region, address_count)`` may come from elsewhere; regions it
    does not list are dropped. ``cap`` is what to expect, not a bound.
    """
    kept = df.where(F.col(region).isNotNull() & ~F.col(region).isin(list(exclude)))
    if counts is None:
        counts = kept.groupBy(region).agg(F.count(F.lit(1)).alias("address_count"))
    chance = counts.where(F.col("address_count") > 0).select(
        F.col(region), F.least(F.lit(1.0), F.lit(float(cap)) / F.col("address_count")).alias("_p")
    )
    chance, seen = cut_with(chance)
    return kept.join(sized(chance, seen["rows"]), region).where(unit_hash(key, seed, method) < F.col("_p")).drop("_p")


def reservoir(
    df: DataFrame, by: Sequence[str], n: int, key: str, seed: int = 0, method: str = "xx", cap: str | None = None
) -> DataFrame:
    """Uniform sample of exactly min(n, group size) rows per group.

    Rows are taken in hash order, so Spark trims each partition before the
    shuffle and a crowded group never meets in one task. ``cap`` names a
    column with a smaller limit per row's group.
    """
    order = W.partitionBy(*by).orderBy("_h", key)
    ranked = df.withColumn("_h", unit_hash(key, seed, method)).withColumn("_rank", F.row_number().over(order))
    ranked = ranked.where(F.col("_rank") <= n)
    if cap:
        ranked = ranked.where(F.col("_rank") <= F.col(cap))
    return ranked.drop("_h", "_rank")


def sample_page(
    df: DataFrame, number: int, seed: int, page_size: int, page: int, key: str = "id", method: str = "xx"
) -> DataFrame:
    """Page ``page`` (from 0) of a seeded sample of ``number`` rows in key order."""
    drawn = df.withColumn("_h", unit_hash(key, seed, method)).orderBy("_h", key).limit(number).drop("_h")
    return drawn.orderBy(key).offset(page * page_size).limit(page_size)


def tier_cdf(temperature: float = TIER_TEMPERATURE) -> list[float]:
    weights = [2 ** (-t / temperature) for t in range(1, MAX_TIER + 1)]
    total, run, out = sum(weights), 0.0, []
    for w in weights:
        run += w / total
        out.append(run)
    return out


def tier_of(p: Column, temperature: float = TIER_TEMPERATURE) -> Column:
    """First tier whose cumulative weight reaches ``p``."""
    cdf = F.array(*[F.lit(x) for x in tier_cdf(temperature)[:-1]])
    return (F.size(F.filter(cdf, lambda x: x < p)) + 1).cast("int")


def draw_tier(
    df: DataFrame, key: str, temperature: float = TIER_TEMPERATURE, seed: int = 0, method: str = "xx", name: str = "tier"
) -> DataFrame:
    return df.withColumn(name, tier_of(unit_hash(key, seed, method), temperature))


def category_for(tier: Column, p: Column, min_tiers: dict[str, int] | None = None) -> Column:
    """Number of a category open to ``tier``, uniform in ``p``; null if none."""
    mins = list((min_tiers or CATEGORY_MIN_TIER).values())
    nums = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("min")) for i, m in enumerate(mins)])
    open_ = F.transform(F.filter(nums, lambda c: c["min"] <= tier), lambda c: c["no"])
    at = F.floor(p * F.size(open_)).cast("int") + 1
    return F.try_element_at(open_, at)


def draw_category(
    df: DataFrame, key: str, tier: str = "tier", seed: int = 0, method: str = "xx", name: str = "category",
    min_tiers: dict[str, int] | None = None,
) -> DataFrame:
    return df.withColumn(name, category_for(F.col(tier), unit_hash(key, seed, method), min_tiers))


def tier_weights(df: DataFrame, tier: str = "tier", temperature: float = TIER_TEMPERATURE) -> DataFrame:
    """Observed share of each tier beside its weight and cumulative weight."""
    cdf = F.array(*[F.lit(x) for x in tier_cdf(temperature)])
    seen = df.groupBy(tier).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    cum = F.element_at(cdf, F.col(tier).cast("int"))
    prev = F.coalesce(F.get(cdf, (F.col(tier) - 2).cast("int")), F.lit(0.0))
    prev = F.when(F.col(tier) > 1, prev).otherwise(F.lit(0.0))
    return seen.select(
        tier, "rows", (F.col("rows") / total).alias("share"), (cum - prev).alias("weight"), cum.alias("cumulative")
    )


def annulus_point(lat, lon, r_min, r_max, u: Column, v: Column) -> tuple[Column, Column]:
    """Area-uniform point between two radii in metres, from two numbers in [0, 1)."""
    from ..functions.geo import METRES_PER_DEGREE

    lat, lon = F.col(lat), F.col(lon)
    lo, hi = [F.col(r) if isinstance(r, str) else F.lit(float(r)) for r in (r_min, r_max)]
    theta = u * (2 * math.pi)
    r = F.sqrt(lo * lo + v * (hi * hi - lo * lo))
    return (
        lat + r * F.sin(theta) / METRES_PER_DEGREE,
        lon + r * F.cos(theta) / (F.cos(F.radians(lat)) * METRES_PER_DEGREE),
    )
