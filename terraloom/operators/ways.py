"""Way filters and per-way columns: routable rules, speed, direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T


def routable(tags: str = "tags", profile: str = "standard") -> Column:
    """Whether a way belongs to the routable network.

    ``standard`` checks class and access, ``legacy`` a wider class list
    without any access check, ``all`` every listed class plus platforms.
    """
    highway = F.coalesce(T.tag(tags, "highway"), F.lit(""))
    if profile == "standard":
        return highway.isin(T.ROUTABLE_HIGHWAYS) & T.not_denied(tags)
    if profile == "legacy":
        return highway.isin(T.ROUTABLE_HIGHWAYS + T.LEGACY_EXTRA_HIGHWAYS)
    if profile == "all":
        listed = highway.isin(T.ROUTABLE_HIGHWAYS + T.LEGACY_EXTRA_HIGHWAYS + T.PROFILE_EXTRA_HIGHWAYS)
        return listed | is_platform(tags)
    raise ValueError(f"unknown profile {profile!r}")


def is_platform(tags: str = "tags") -> Column:
    return F.coalesce(T.tag(tags, "railway") == "platform", F.lit(False)) | F.coalesce(
        T.tag(tags, "public_transport") == "platform", F.lit(False)
    )


def routable_ways(ways: DataFrame, profile: str = "standard") -> DataFrame:
    return ways.where(routable("tags", profile))


def network_ways(ways: DataFrame, routable_only: bool = False) -> DataFrame:
    """Routable ways, ferries and any highway; or only the routable ones."""
    if routable_only:
        return ways.where(routable("tags"))
    ferry = F.coalesce(T.tag("tags", "route") == "ferry", F.lit(False))
    return ways.where(ferry | T.tag("tags", "highway").isNotNull())


def with_speed_limit(ways: DataFrame, rule: str = "leading", name: str = "maxspeed_kmh") -> DataFrame:
    return ways.withColumn(name, T.posted_kmh("tags", rule))


def profile_speed(tags: str = "tags") -> Column:
    """Whole km/h by class: fixed values, or the base speed under a cap."""
    h = T.tag(tags, "highway")
    default = F.lit(T.DEFAULT_OTHER_KMH)
    for name, kmh in T.DEFAULT_KMH.items():
        default = F.when(h == name, kmh).otherwise(default)
    base = F.coalesce(F.floor(T.posted_kmh(tags)).cast("int"), default)
    out = F.when(is_platform(tags), T.PLATFORM_KMH).otherwise(base)
    for kmh, names in T.PROFILE_CAP_KMH.items():
        out = F.when(h.isin(names), F.least(base, F.lit(kmh))).otherwise(out)
    for kmh, names in T.PROFILE_FIXED_KMH.items():
        out = F.when(h.isin(names), F.lit(kmh)).otherwise(out)
    return out.cast("int")


def with_profile_speed(ways: DataFrame, name: str = "speed_kmh") -> DataFrame:
    return ways.withColumn(name, profile_speed("tags"))


def direction(tags: str = "tags") -> Column:
    """``both``, ``forward`` or ``backward``.

    Foot and cycle classes are open both ways unless ``oneway`` says
    otherwise; other classes also take roundabouts and motorways as one-way.
    """
    h, oneway = T.tag(tags, "highway"), F.coalesce(T.tag(tags, "oneway"), F.lit(""))
    soft = F.coalesce(h.isin("path", "footway", "cycleway", "pedestrian", "bridleway"), F.lit(False))
    implied = F.coalesce(T.tag(tags, "junction") == "roundabout", F.lit(False)) | F.coalesce(
        h.isin("motorway", "motorway_link"), F.lit(False)
    )
    return (
        F.when(oneway.isin("yes", "true", "1"), "forward")
        .when(oneway.isin("-1", "reverse"), "backward")
        .when(~soft & implied & (oneway != "no"), "forward")
        .otherwise("both")
    )


def with_direction(ways: DataFrame, name: str = "direction") -> DataFrame:
    return ways.withColumn(name, direction("tags"))
