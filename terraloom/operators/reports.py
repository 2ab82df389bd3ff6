"""Counting reports over addresses, places, snapped pairs and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, cut_with, sized
from .ranking import running_sum

# Steps of the quantile summary between which a rank is looked for, and the
# summary's accuracy: its ranks are off by at most a share of 1 / SKETCH.
SPLITS, SKETCH = 128, 10_000


def tag_identifiers(addresses: DataFrame, tags: str = "tags") -> DataFrame:
    """One row per counted tag of each address.

    Address tags are left out; building, amenity and shop keep their value.
    Rows whose JSON cannot be read are skipped.
    """
    parsed = F.from_json(F.col(tags), "map<string,string>", {"mode": "PERMISSIVE"})
    rows = addresses.withColumn("_t", parsed).where(F.col("_t").isNotNull())
    keep = [c for c in addresses.columns if c != tags]
    rows = rows.select(*keep, F.explode("_t").alias("_k", "_v")).where(~F.col("_k").startswith("addr:"))
    named = F.when(F.col("_k").isin("building", "amenity", "shop"), F.concat_ws("=", "_k", "_v")).otherwise(F.col("_k"))
    return rows.withColumn("tag", named).drop("_k", "_v")


def tag_counts(addresses: DataFrame, by_region: bool = True, tags: str = "tags", region: str = "region") -> DataFrame:
    """Rows per tag, and per region with ``by_region``."""
    keys = ["tag", region] if by_region else ["tag"]
    return tag_identifiers(addresses, tags).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def tag_totals(counts: DataFrame, top: int = 20) -> DataFrame:
    """Most frequent tags over all regions."""
    return counts.groupBy("tag").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "tag").limit(top)


def tag_matrix(counts: DataFrame, regions: list[str], region: str = "region") -> DataFrame:
    """Tags as rows, the named regions as columns, missing counts 0."""
    return counts.groupBy("tag").pivot(region, regions).agg(F.sum("rows")).na.fill(0)


def tag_coverage(counts: DataFrame, n: int = 10, region: str = "region") -> DataFrame:
    """Tags seen at least ``n`` times in every region of the table."""
    regions = counts.select(region).where(F.col(region).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()
    enough = F.sum(F.when(F.col(region).isNotNull() & (F.col("rows") >= n), 1).otherwise(0))
    return counts.groupBy("tag").agg(enough.alias("regions"), F.sum("rows").alias("rows")).where(F.col("regions") == regions)


def region_counts(df: DataFrame, region: str = "region", top: int | None = None) -> DataFrame:
    """Rows per region, largest first when cut to ``top``."""
    out = df.where(F.col(region).isNotNull()).groupBy(region).agg(F.count(F.lit(1)).alias("address_count"))
    return out.orderBy(F.desc("address_count"), region).limit(top) if top else out


def snap_stats(pairs: DataFrame, distance: str = "distance") -> DataFrame:
    """Average, median and largest snapping distance.

    The median of an even number of pairs is the mean of the middle two.
    """
    one = pairs.select(F.lit(0).alias("_all"), F.col(distance).alias("value"))
    n = F.col("_n")
    middle = {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1}
    halves = values_at_ranks(one, ["_all"], "value", middle).select(((F.col("low") + F.col("high")) / 2).alias("median_m"))
    out = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg(distance).alias("avg_m"), F.max(distance).alias("max_m"))
    # Both sides are single rows.
    return out.join(F.broadcast(halves), F.lit(True), "left").select("pairs", "avg_m", "median_m", "max_m")


def category_share(places: DataFrame) -> DataFrame:
    """Share of node places per category, and in how many regions it occurs."""
    return places.groupBy("category").agg(
        F.count(F.lit(1)).alias("places"), F.avg(F.col("is_node").cast("double")).alias("node_share"),
        F.count_distinct("region").alias("regions"),
    )


def places_in(places: DataFrame, prefix: str) -> DataFrame:
    """Places of regions whose code starts with ``prefix``."""
    return places.where(F.col("region").startswith(prefix))


def regions_present(regions: DataFrame, places: DataFrame, code: str = "code") -> DataFrame:
    """Regions some place lies in."""
    return regions.join(places.select(F.col("region").alias(code)), code, "left_semi")


def latency_report(events: DataFrame, p: float = 0.95, name: str = "timer", ms: str = "ms") -> DataFrame:
    """Count, total, average, extremes and nearest-rank percentile per timer."""
    stats = events.groupBy(name).agg(
        F.count(F.lit(1)).alias("count"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("avg_ms"),
        F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
    )
    return stats.join(nearest_rank(events, p, [name], ms).select(name, F.col("value").alias("p_ms")), name)


def nearest_rank(df: DataFrame, p: float, group: list[str], value: str) -> DataFrame:
    """Value at rank ceil(p*n) (at least 1) of each group, counting ties."""
    return values_at_ranks(df, group, value, {"value": F.greatest(F.ceil(F.col("_n") * F.lit(p)), F.lit(1))})


def values_at_ranks(df: DataFrame, group: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The values at some ranks of each group, one column per rank.

    A rank is an expression of ``_n``, the group's number of values. A
    mergeable quantile summary brackets each rank between two of ``SPLITS``
    steps; one more pass counts what lies below and the values inside, which
    are few. Ranks that a bracket should miss are looked up without one.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_value"))
    steps = F.array(*[F.lit(k / SPLITS) for k in range(SPLITS + 1)])
    sketch = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_value", steps, SKETCH).alias("_s")))
    asked = sketch.select(*group, "_n", "_s", F.inline(F.array(*[F.struct(F.lit(k).alias("_name"), r.cast("long").alias("_r")) for k, r in ranks.items()])))
    # A step aside on both sides, which is far more than the summary's error.
    low = (F.floor((F.col("_r") - 1) * SPLITS / F.col("_n")) - 1).cast("int")
    high = (F.ceil(F.col("_r") * SPLITS / F.col("_n")) + 1).cast("int")
    brackets, seen = cut_with(asked.select(
        *group, "_name", "_r", F.when(low > 0, F.get("_s", low)).alias("_low"), F.when(high < SPLITS, F.get("_s", high)).alias("_high")))
    found, figures = cut_with(_in_brackets(rows, brackets, seen["rows"], group))
    if figures["rows"] < seen["rows"]:
        missed = brackets.join(found.select(*group, "_name"), [*group, "_name"], "left_anti")
        none = F.lit(None).cast(rows.schema["_value"].dataType)
        found = found.unionByName(_in_brackets(rows, missed.withColumn("_low", none).withColumn("_high", none), seen["rows"], group))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == k, F.col("_at"))).alias(k) for k in ranks])


def _in_brackets(rows: DataFrame, brackets: DataFrame, n: int, group: list[str]) -> DataFrame:
    """Group, _name, _at: the value at rank _r where it lies in its bracket."""
    met = rows.join(sized(brackets, n), group).where(F.col("_high").isNull() | (F.col("_value") <= F.col("_high")))
    # All values below the bracket are one row without a value, in front.
    inside = F.when(F.col("_low").isNull() | (F.col("_value") >= F.col("_low")), F.col("_value"))
    freq = cut(met.groupBy(*group, "_name", "_r", inside.alias("_at")).agg(F.count(F.lit(1)).alias("_w")))
    upto = running_sum(freq, "_w", [F.col("_at")], [*group, "_name", "_r"], name="_upto")
    hit = upto.where((F.col("_upto") >= F.col("_r")) & (F.col("_upto") - F.col("_w") < F.col("_r")) & F.col("_at").isNotNull())
    return hit.select(*group, "_name", "_at")


def run_summary(results: DataFrame, ok: str = "ok") -> DataFrame:
    """Total, successes, failures and success rate of a run."""
    good: Column = F.coalesce(F.sum(F.when(F.col(ok), 1).otherwise(0)), F.lit(0)).cast("long")
    n = F.count(F.lit(1))
    return results.agg(
        n.alias("total"), good.alias("success"), (n - good).alias("failure"),
        F.when(n > 0, good * 100.0 / n).otherwise(0.0).alias("success_percent"),
    )
