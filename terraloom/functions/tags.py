"""Column builders over a MAP<STRING,STRING> of element tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Highway classes of the standard routable rule.
ROUTABLE_HIGHWAYS = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential",
    "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link",
    "living_street", "service", "busway",
    "track", "path", "footway", "cycleway", "bridleway",
    "pedestrian", "steps", "construction",
]
# Classes the legacy rule adds.
LEGACY_EXTRA_HIGHWAYS = ["bus_guideway", "raceway", "road", "escape", "corridor"]
# Further classes of the all-inclusive profile.
PROFILE_EXTRA_HIGHWAYS = [
    "bus_stop", "crossing", "emergency_access_point", "give_way", "mini_roundabout",
    "motorway_junction", "passing_place", "platform", "rest_area", "services", "speed_camera",
    "stop", "street_lamp", "traffic_signals", "turning_circle", "turning_loop",
    "proposed", "planned", "abandoned", "disused", "razed",
    "via_ferrata", "elevator", "escalator",
]
DENIED = ["no", "private"]
MPH_TO_KMH = 1.609344

# Report groups of highway classes, most important first.
HIGHWAY_GROUPS = {
    "Major roads": ["motorway", "trunk", "primary", "secondary"],
    "Minor roads": ["tertiary", "unclassified", "residential"],
    "Link roads": ["motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link"],
    "Paths/pedestrian": ["path", "footway", "cycleway", "bridleway", "steps", "pedestrian"],
    "Service/other": ["service", "living_street", "track", "busway"],
}
OTHER_GROUP = "Other/unknown"

# Profile speeds in km/h that replace any posted speed.
PROFILE_FIXED_KMH = {
    5: ["steps", "via_ferrata", "elevator", "escalator"],
    10: ["abandoned", "disused", "razed", "bus_stop", "crossing", "give_way", "mini_roundabout",
         "motorway_junction", "passing_place", "rest_area", "services", "speed_camera", "stop",
         "street_lamp", "traffic_signals", "turning_circle", "turning_loop"],
}
# Upper limits in km/h by class.
PROFILE_CAP_KMH = {
    20: ["path", "footway", "cycleway", "pedestrian", "platform", "corridor"],
    30: ["service", "living_street", "track", "bridleway", "construction", "proposed", "planned"],
    40: ["escape", "emergency_access_point"],
    50: ["residential", "unclassified", "road"],
    60: ["bus_guideway", "busway"],
    80: ["raceway"],
}
PLATFORM_KMH = 10
# Our own base speeds where no limit is posted.
DEFAULT_KMH = {
    "motorway": 120, "motorway_link": 60, "trunk": 100, "trunk_link": 50, "primary": 80,
    "primary_link": 50, "secondary": 70, "secondary_link": 50, "tertiary": 60, "tertiary_link": 50,
}
DEFAULT_OTHER_KMH = 50


def _map(tags) -> Column:
    return F.col(tags) if isinstance(tags, str) else tags


def tag(tags, key: str) -> Column:
    return F.try_element_at(_map(tags), F.lit(key))


def has_address(tags) -> Column:
    return F.coalesce(F.exists(F.map_keys(_map(tags)), lambda k: k.startswith("addr:")), F.lit(False))


def has_building(tags) -> Column:
    return tag(tags, "building").isNotNull()


def not_denied(tags) -> Column:
    ok = F.lit(True)
    for key in ("access", "motor_vehicle", "vehicle"):
        ok = ok & ~F.coalesce(tag(tags, key), F.lit("")).isin(DENIED)
    return ok


def sorted_json(tags) -> Column:
    """Tags as a JSON object with keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_map(tags)))))


def highway_group(highway) -> Column:
    h = F.col(highway) if isinstance(highway, str) else highway
    out = None
    for name, members in HIGHWAY_GROUPS.items():
        out = F.when(h.isin(members), name) if out is None else out.when(h.isin(members), name)
    return out.otherwise(OTHER_GROUP)


def posted_kmh(tags, rule: str = "leading") -> Column:
    """Speed of the ``maxspeed`` text in km/h, null where it cannot be read.

    ``leading`` reads the number at the start and wants it above zero;
    ``token`` wants the whole first word to be a number.
    """
    text = F.lower(tag(tags, "maxspeed"))
    if rule == "leading":
        digits = F.regexp_extract(text, r"^\s*([0-9.]+)", 1)
        value = F.nullif(digits, F.lit("")).try_cast("double")
        value = F.when(value > 0, value)
    elif rule == "token":
        bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "km/h", ""), "kph", ""))
        word = F.regexp_extract(bare, r"^(\S+)", 1)
        numeric = word.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$")
        value = F.when(numeric, word.try_cast("double"))
    else:
        raise ValueError(f"unknown maxspeed rule {rule!r}")
    return F.when(text.contains("mph"), value * MPH_TO_KMH).otherwise(value)
