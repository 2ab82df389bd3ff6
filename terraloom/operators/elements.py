"""Address, building and place tables from map elements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import tags as T
from ..scratch import cut, cut_with, spread
from .regions import RegionCover, assign_regions
from .sampling import reservoir
from .tiles import build_tile_index, nearest
from .ways import network_ways


@dataclass
class Osm:
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


def located_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(geo.located("lat", "lon"))


def way_members(ways: DataFrame) -> DataFrame:
    """(way_id, pos, node_id) for each reference of each way."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))


def mean_degrees(c: str) -> Column:
    """Mean of a group's degrees from their exact sum, so that no order of
    the rows moves a centre across a region's border."""
    return F.sum(F.col(c).cast("decimal(20,17)")).cast("double") / F.count(c)


def way_points(ways: DataFrame, nodes: DataFrame, way_point: str = "mean", members: int = 0) -> DataFrame:
    """(id, lat, lon, located) per way with at least one located node.

    ``mean`` averages member nodes, a repeated node counting each time;
    ``middle`` and ``first`` take one member. ``members`` is the number of
    references, where it has been counted: parts follow it.
    """
    spots = located_nodes(nodes).select(F.col("id").alias("node_id"), "lat", "lon")
    if way_point == "mean":
        met = spread(way_members(ways), members, "node_id").join(spots, "node_id")
        return (
            spread(met, members, "way_id").groupBy(F.col("way_id").alias("id"))
            .agg(mean_degrees("lat").alias("lat"), mean_degrees("lon").alias("lon"), F.count(F.lit(1)).alias("located"))
        )
    if way_point == "middle":
        pick = F.try_element_at("refs", F.floor(F.size("refs") / 2).cast("int") + 1)
    elif way_point == "first":
        pick = F.try_element_at("refs", F.lit(1))
    else:
        raise ValueError(f"unknown way point {way_point!r}")
    one = ways.select("id", pick.alias("node_id"))
    return one.join(spots, "node_id").select("id", "lat", "lon", F.lit(1).cast("long").alias("located"))


def outer_members(relations: DataFrame) -> DataFrame:
    """(id, way_id) for the outer ways of each relation."""
    members = relations.select("id", F.explode("members").alias("m"))
    return members.where((F.col("m.type") == "way") & (F.col("m.role") == "outer")).select(
        "id", F.col("m.ref").alias("way_id")
    )


def _record(df: DataFrame, kind: str) -> DataFrame:
    flag = {k: F.lit(int(k == kind)) for k in ("relation", "node", "way")}
    return df.select(
        "id",
        T.has_building("tags").cast("int").alias("is_building"),
        T.has_address("tags").cast("int").alias("is_addr"),
        flag["relation"].alias("is_relation"), flag["node"].alias("is_node"), flag["way"].alias("is_way"),
        "lat", "lon",
        F.coalesce(T.tag("tags", "addr:city"), F.lit("")).alias("city"),
        T.sorted_json("tags").alias("tags"),
    )


def address_or_building(df: DataFrame) -> DataFrame:
    return df.where(T.has_address("tags") | T.has_building("tags"))


def extract_addresses(osm: Osm, way_point: str = "mean") -> DataFrame:
    """Address and building records of nodes, ways and relations.

    A relation sits at the mean of its outer ways weighted by their number of
    located nodes. ``way_point='none'`` keeps nodes only.
    """
    if way_point == "none":
        return _record(address_or_building(located_nodes(osm.nodes)), "node")
    # Elements are built once for all three kinds.
    own = T.has_address("tags") | T.has_building("tags")
    nodes = cut(located_nodes(osm.nodes).select("id", "lat", "lon", F.when(own, F.col("tags")).alias("tags")))
    out = _record(address_or_building(nodes), "node")
    ways, seen = cut_with(osm.ways.select("id", "refs", F.when(own, F.col("tags")).alias("tags")), members=F.sum(F.coalesce(F.size("refs"), F.lit(0)).cast("long")))
    members = max(seen["members"] or 0, 0)
    tagged_ways = address_or_building(ways)
    if way_point != "mean":
        placed = tagged_ways.join(way_points(tagged_ways, nodes, way_point), "id")
        return out.unionByName(_record(placed.where(geo.located("lat", "lon")), "way"))
    wanted = cut(address_or_building(osm.relations))
    outer = outer_members(wanted)
    # Outer ways are rarely tagged themselves, so they are placed from all ways.
    used = tagged_ways.select("id").unionByName(outer.select(F.col("way_id").alias("id"))).distinct()
    spots = cut(way_points(ways.join(used, "id", "left_semi"), nodes, members=members))
    placed = spread(tagged_ways.select("id", "tags"), seen["rows"], "id").join(spots, "id")
    out = out.unionByName(_record(placed.where(geo.located("lat", "lon")), "way"))
    weighted = spread(outer, seen["rows"], "way_id").join(spots.withColumnRenamed("id", "way_id"), "way_id")
    centers = weighted.groupBy("id").agg(
        (F.sum(F.col("lat") * F.col("located")) / F.sum("located")).alias("lat"),
        (F.sum(F.col("lon") * F.col("located")) / F.sum("located")).alias("lon"),
    )
    rels = wanted.join(centers, "id").where(geo.located("lat", "lon"))
    return out.unionByName(_record(rels, "relation"))


def with_address_fields(df: DataFrame) -> DataFrame:
    """Street, house number, postcode and city columns from tags."""
    return df.withColumns({
        "street": T.tag("tags", "addr:street"), "house_number": T.tag("tags", "addr:housenumber"),
        "postcode": T.tag("tags", "addr:postcode"), "city": T.tag("tags", "addr:city"),
    })


def addresses_with_nodes(addresses: DataFrame, nodes: DataFrame, max_m: float | None = None) -> DataFrame:
    """Address fields and the closest network node of every address.

    Addresses without a node within ``max_m`` keep null node columns.
    """
    near = nearest(addresses, build_tile_index(nodes, "id", "lat", "lon"), "id", "lat", "lon", max_distance=max_m)
    spots = nodes.select(F.col("id").alias("near_id"), F.col("lat").alias("closest_node_lat"), F.col("lon").alias("closest_node_lon"))
    near = near.select("id", "near_id", F.col("distance").alias("distance_meters")).join(spots, "near_id")
    tag = {c: T.tag("tags", c).alias(c) for c in ("addr:street", "addr:housenumber", "addr:postcode", "addr:city")}
    base = addresses.select("id", F.col("lon").alias("address_lon"), F.col("lat").alias("address_lat"), *tag.values())
    return base.join(near, "id", "left").select(
        F.col("id").alias("address_id"), "address_lon", "address_lat", *[F.col(f"`{c}`") for c in tag],
        F.col("near_id").alias("closest_node_id"), "closest_node_lon", "closest_node_lat", "distance_meters")


def trim_network(osm: Osm, routable_only: bool = False) -> Osm:
    """Ways of the network and the bare nodes they reference."""
    ways = network_ways(osm.ways, routable_only)
    used = way_members(ways).select(F.col("node_id").alias("id"))
    nodes = osm.nodes.join(used, "id", "left_semi").select("id", "lat", "lon")
    return Osm(nodes, ways, osm.relations)


def element_counts(osm: Osm) -> DataFrame:
    """Rows per element kind, and the total."""
    parts = None
    for kind, df in (("node", osm.nodes), ("way", osm.ways), ("relation", osm.relations)):
        one = df.agg(F.count(F.lit(1)).alias("elements")).select(F.lit(kind).alias("kind"), "elements")
        parts = one if parts is None else parts.unionByName(one)
    return parts.rollup("kind").agg(F.sum("elements").alias("elements")).select(
        F.coalesce("kind", F.lit("total")).alias("kind"), "elements"
    )


# Place categories in matching order, each with its tag rules.
PLACE_CATEGORIES = [
    ("residential", ["landuse=residential", "building=residential", "building=house", "building=apartments",
                     "building=detached", "building=semidetached_house", "building=terrace", "building=houseboat"]),
    ("office", ["office=*", "office=company"]),
    ("shop", ["shop=supermarket", "shop=clothes", "shop=car", "shop=butcher", "shop=florist", "shop=jewelry",
              "shop=hardware", "shop=furniture"]),
    ("restaurant", ["amenity=restaurant", "amenity=cafe", "amenity=fast_food"]),
    ("port", ["industrial=port"]),
    ("farm", ["landuse=farmland"]),
    ("power_plant", ["power=generator"]),
    ("factory", ["man_made=works"]),
    ("railway_terminal", ["railway=yard"]),
    ("station", ["railway=station"]),
    ("airport", ["aeroway=aerodrome"]),
    ("warehouse", ["building=warehouse"]),
    ("mine", ["landuse=quarry"]),
    ("gas_station", ["amenity=fuel"]),
    ("construction", ["landuse=construction"]),
]
DEFAULT_CATEGORY_CAP = 100


@dataclass
class CategoryRule:
    name: str
    max_per_region: int
    tags: list[tuple[str, str]]


def category_rules(source=None) -> list[CategoryRule]:
    """Ordered rules from (name, tags[, cap]) entries or a YAML file path."""
    if source is None:
        source = PLACE_CATEGORIES
    if isinstance(source, str):
        import yaml

        with open(source) as f:
            doc = yaml.safe_load(f)
        listed = doc.get("categories") if isinstance(doc, dict) else None
        if not isinstance(listed, list):
            raise ValueError("'categories' must be a list")
        source = []
        for c in listed:
            if not c.get("name"):
                raise ValueError("a category needs a name")
            if not isinstance(c.get("tags"), list):
                raise ValueError(f"category {c['name']} needs a list of tags")
            source.append((c["name"], c["tags"], c.get("max_per_region", DEFAULT_CATEGORY_CAP)))
    out = []
    for name, tags, *cap in source:
        for t in tags:
            if "=" not in t:
                raise ValueError(f"tag rule {t!r} is not key=value")
        pairs = [tuple(t.split("=", 1)) for t in tags]
        out.append(CategoryRule(name, int(cap[0]) if cap else DEFAULT_CATEGORY_CAP, pairs))
    return out


def category_of(rules: list[CategoryRule], tags: str = "tags") -> Column:
    """Name of the first category with a matching tag rule, else null."""
    if not rules:
        return F.lit(None).cast("string")
    # Each key is looked up once; the smallest rule number that fits wins.
    wanted: dict[str, list[tuple[str, int]]] = {}
    for no, rule in enumerate(rules):
        for key, value in rule.tags:
            wanted.setdefault(key, []).append((value, no))
    ranks = [F.lit(None).cast("int")] * 2
    for key, values in wanted.items():
        v, pick = T.tag(tags, key), None
        every = min([no for value, no in values if value == "*"], default=len(rules))
        for no in sorted({no for _, no in values}):
            names = [value for value, n in values if n == no and value != "*"]
            if names and no < every:
                pick = F.when(v.isin(names), no) if pick is None else pick.when(v.isin(names), no)
        if every < len(rules):
            pick = F.when(v.isNotNull(), every) if pick is None else pick.when(v.isNotNull(), every)
        if pick is not None:
            ranks.append(pick)
    return F.get(F.array(*[F.lit(r.name) for r in rules]), F.least(*ranks))


def _place(df: DataFrame, kind: str) -> DataFrame:
    return df.select(
        "id", "category", "lat", "lon",
        geo.mercator_x("lon").alias("x_mercator"), geo.mercator_y("lat").alias("y_mercator"), "region",
        *[F.lit(int(k == kind)).alias(f"is_{k}") for k in ("node", "way", "relation")],
        T.sorted_json("tags").alias("tags"),
    )


def extract_places(
    osm: Osm, rules: list[CategoryRule], cover: RegionCover, all_nodes: bool = False
) -> DataFrame:
    """Categorised places of all element kinds, before sampling.

    Ways average those member nodes that lie in some region, relations
    average the centres of their outer ways equally; ``all_nodes`` lets
    members outside every region count too.
    """
    category = category_of(rules)
    how = "left" if all_nodes else "inner"
    # Only ways with a category, or outer in a relation with one, are placed;
    # elements and tagged positions are written once for all three kinds.
    kept = F.when(F.col("category").isNotNull(), F.col("tags")).alias("tags")
    built, seen = cut_with(osm.ways.withColumn("category", category).select("id", "refs", "category", kept),
                           members=F.sum(F.coalesce(F.size("refs"), F.lit(0)).cast("long")))
    tagged = built.where(F.col("category").isNotNull()).select("id", "category", "tags")
    rels = cut(osm.relations.withColumn("category", category).where(F.col("category").isNotNull()))
    members = outer_members(rels)
    used = tagged.select("id").unionByName(members.select(F.col("way_id").alias("id"))).distinct()
    spots = osm.nodes.where(geo.located("lat", "lon")).withColumn("category", category).select("id", "lat", "lon", "category", kept)
    nodes = cut(assign_regions(spots, cover, how=how))
    out = _place(nodes.where("region is not null and category is not null"), "node")
    centers = way_points(built.select("id", "refs").join(used, "id", "left_semi"), nodes.select("id", "lat", "lon"), members=max(seen["members"] or 0, 0))
    ways = cut(assign_regions(centers, cover, how=how))
    out = out.unionByName(_place(spread(tagged, seen["rows"], "id").join(ways.where(F.col("region").isNotNull()), "id"), "way"))
    spots = members.join(
        ways.select(F.col("id").alias("way_id"), "lat", "lon"), "way_id"
    ).groupBy("id").agg(mean_degrees("lat").alias("lat"), mean_degrees("lon").alias("lon"))
    placed = assign_regions(rels.select("id", "category", "tags").join(spots, "id"), cover, how="inner")
    return out.unionByName(_place(placed, "relation"))


def sample_places(places: DataFrame, rules: list[CategoryRule], seed: int = 0, method: str = "xx") -> DataFrame:
    """At most the category's cap per element kind, category and region."""
    caps = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.max_per_region)])
    kind = F.when(F.col("is_node") == 1, "node").when(F.col("is_way") == 1, "way").otherwise("relation")
    tagged = places.withColumn("_kind", kind).withColumn("_cap", caps[F.col("category")])
    picked = reservoir(tagged, ["_kind", "category", "region"], max(r.max_per_region for r in rules), "id",
                       seed, method, cap="_cap")
    return picked.drop("_kind", "_cap")
