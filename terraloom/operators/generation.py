"""Delivery-job generation for whole address tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.hashing import unit_hash
from ..scratch import cut, cut_with
from ..sources.writers import write_generated
from .annulus import PointOrder, pick_in_band
from .fleet import without_jobs
from .roadblocks import build_road_blocks, goal_paths
from .routing import snap
from .sampling import MAX_TIER, TIER_RANGES_KM, category_for, tier_of

MAX_RETRIES = 5
DETOUR_FACTOR = 10.0


@dataclass
class Generated:
    jobs: DataFrame
    rejects: DataFrame


def graph_router(arcs: DataFrame, nodes: DataFrame, snap_m: float = 1000.0):
    """Router giving the driven metres of (id, from, to) rows over a graph.

    The graph is cut into blocks once, for all rounds of generation.
    """
    roads: list = []

    def route(trips: DataFrame) -> DataFrame:
        if not roads:
            roads.append(build_road_blocks(arcs, nodes))
        legs = cut(snap(trips, nodes, snap_m, key="id"))
        found = goal_paths(roads[0], legs, key="id").routes.where("success")
        walks = legs.select("id", F.floor(F.col("start_walk_m") + F.col("end_walk_m")).alias("_w"))
        return found.join(walks, "id").select("id", (F.col("distance_m") + F.col("_w")).cast("double").alias("route_m"))
    return route


def generate_jobs(
    addresses: DataFrame,
    existing: DataFrame | None,
    route: Callable[[DataFrame], DataFrame],
    seed: int = 0,
    mode: str = "missing",
    limit: int | None = None,
    method: str = "xx",
    ranges: dict[int, tuple[float, float]] | None = None,
    min_tiers: dict[str, int] | None = None,
    max_retries: int = MAX_RETRIES,
) -> Generated:
    """One job per address, in at most ``max_retries + 1`` rounds.

    Every round draws a tier, a destination in the tier's square annulus and
    a route. No destination tries the next tier; no route tries again,
    drawing a new tier unless one was forced. A route over ten times the
    straight line is dropped. ``mode='missing'`` skips addresses that have a
    job. ``route(trips)`` returns (id, route_m) for the trips it can drive.
    """
    if mode not in ("missing", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    ranges = ranges or TIER_RANGES_KM
    base = addresses.select("id", "lat", "lon")
    todo = base if mode == "all" or existing is None else without_jobs(base, existing)
    if limit is not None:
        todo = todo.orderBy("id").limit(limit)
    todo, seen = cut_with(todo.withColumn("forced", F.lit(None).cast("int")))
    jobs, rejects = None, None
    order = PointOrder(base) if seen["rows"] else None

    def more(acc: DataFrame | None, df: DataFrame) -> DataFrame:
        return df if acc is None else acc.unionByName(df)

    for attempt in range(max_retries + 1):
        if seen["rows"] == 0:
            break
        s = seed + 7919 * attempt
        drawn = cut(todo.withColumn("tier", F.coalesce("forced", tier_of(unit_hash("id", s + 1, method)))))
        picked = pick_in_band(drawn, order, ranges, request="id", band="tier", seed=s + 2, method=method)
        with_end = cut(drawn.join(picked, "id", "left"))
        trips = with_end.where("picked_id is not null").select(
            "id", F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"),
            F.col("picked_lat").alias("to_lat"), F.col("picked_lon").alias("to_lon"),
        )
        done = cut(with_end.join(route(trips), "id", "left"))
        straight = geo.great_circle_km("lat", "lon", "picked_lat", "picked_lon")
        done = done.withColumn("km", F.col("route_m") / 1000.0).withColumn(
            "fate",
            F.when(F.col("picked_id").isNull(), F.when(F.col("tier") < MAX_TIER, "wider").otherwise("no destination"))
            .when(F.col("km").isNull(), "again")
            .when(F.col("km") > straight * DETOUR_FACTOR, "detour").otherwise("job"),
        )
        done = cut(done)
        category = category_for(F.col("tier"), unit_hash("id", s + 3, method), min_tiers)
        jobs = more(jobs, done.where("fate = 'job'").select(
            F.col("id").alias("start_address"), F.col("picked_id").alias("end_address"), "tier", category.alias("category"), "km",
            geo.mercator_x("lon").alias("x"), geo.mercator_y("lat").alias("y"), F.lit(attempt).alias("attempt"),
        ))
        final = F.col("fate").isin("detour", "no destination")
        if attempt == max_retries:
            final = final | F.col("fate").isin("wider", "again")
        reason = F.when(F.col("fate") == "wider", "no destination").when(F.col("fate") == "again", "no route").otherwise(F.col("fate"))
        rejects = more(rejects, done.where(final).select("id", "lat", "lon", "tier", reason.alias("reason"), F.lit(attempt).alias("attempt")))
        if attempt == max_retries:
            break
        todo, seen = cut_with(done.where("fate in ('wider', 'again')").select(
            "id", "lat", "lon", F.when(F.col("fate") == "wider", F.col("tier") + 1).otherwise(F.col("forced")).cast("int").alias("forced")
        ))
    if jobs is None:
        empty = todo.limit(0)
        jobs = empty.select(F.col("id").alias("start_address"), F.col("id").alias("end_address"), F.lit(1).alias("tier"), F.lit(0).alias("category"),
                            F.lit(0.0).alias("km"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("attempt"))
        rejects = empty.select("id", "lat", "lon", F.lit(1).alias("tier"), F.lit("").alias("reason"), F.lit(0).alias("attempt"))
    return Generated(jobs, rejects)


def run_generation(
    addresses: DataFrame, existing: DataFrame | None, route: Callable[[DataFrame], DataFrame], folder: str,
    mode: str = "missing", dry_run: bool = False, **options,
) -> dict:
    """Generate and store jobs and rejects; returns counts by outcome.

    ``mode='all'`` replaces what is stored, ``missing`` adds to it. A dry run
    counts the addresses that would be worked on and stores nothing.
    ``options`` go to ``generate_jobs``.
    """
    if dry_run:
        todo = addresses if mode == "all" or existing is None else without_jobs(addresses, existing)
        n = todo.count()
        limit = options.get("limit")
        return {"addresses": n if limit is None else min(n, limit)}
    made = generate_jobs(addresses, existing, route, mode=mode, **options)
    jobs, seen = cut_with(made.jobs)
    rejects = cut(made.rejects)
    write_generated(jobs, rejects, folder, mode)
    reasons = {r["reason"]: r["n"] for r in rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"addresses": seen["rows"] + sum(reasons.values()), "jobs": seen["rows"], **reasons}
