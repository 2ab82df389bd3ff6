"""Readers for address, building, region, count and element tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.elements import Osm
from ..operators.regions import level_two

ADDRESS_REQUIRED = ["id", "lat", "lon", "nuts_region_code"]
ADDRESS_FIELDS = ["id", "lat", "lon", "street", "house_number", "postcode", "city", "nuts_region_code"]
BUILDING_FIELDS = ["id", "is_building", "is_addr", "is_relation", "is_node", "is_way", "lat", "lon", "city", "tags"]
BUILDING_REQUIRED = ["id", "lat", "lon"]
NODE_SCHEMA = "id bigint, lat double, lon double, tags map<string,string>"
WAY_SCHEMA = "id bigint, refs array<bigint>, tags map<string,string>"
RELATION_SCHEMA = "id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"


def _text(name: str) -> Column:
    """Trimmed text, null when blank."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _csv(spark: SparkSession, path: str, required: list[str], spread: bool) -> DataFrame:
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    # One gzip file is one task; spread its rows before any further work.
    if spread:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def read_addresses(spark: SparkSession, path: str, keep_extra: bool = False) -> DataFrame:
    """Address CSV: trimmed, blanks null, rows without id or coordinates dropped."""
    df = _csv(spark, path, ADDRESS_REQUIRED, path.endswith(".gz"))
    cols = [F.coalesce(_text(c), F.lit(None)).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ADDRESS_FIELDS]
    extra = [F.col(c) for c in df.columns if keep_extra and c not in ADDRESS_FIELDS]
    out = df.select(*cols, *extra).withColumn("lat", F.col("lat").try_cast("double")).withColumn("lon", F.col("lon").try_cast("double"))
    out = out.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return out.withColumnRenamed("nuts_region_code", "region")


def with_location_text(addresses: DataFrame) -> DataFrame:
    """WKT point of each address, as the store keeps it."""
    return addresses.withColumn("location", F.concat(F.lit("POINT("), F.col("lon"), F.lit(" "), F.col("lat"), F.lit(")")))


def read_buildings(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Address/building CSV with 0/1 flags and JSON tags."""
    df = _csv(spark, path, BUILDING_REQUIRED, path.endswith(".gz"))
    if max_rows is not None:
        df = df.limit(max_rows)
    kinds = {**{c: "int" for c in BUILDING_FIELDS if c.startswith("is_")}, "id": "bigint", "lat": "double", "lon": "double"}
    cols = []
    for c in BUILDING_FIELDS:
        col = F.col(c) if c in df.columns else F.lit(None).cast("string")
        cols.append((col.try_cast(kinds[c]) if c in kinds else col).alias(c))
    out = df.select(*cols)
    return out.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def with_tag_map(buildings: DataFrame) -> DataFrame:
    return buildings.withColumn("tags", F.from_json("tags", "map<string,string>"))


def read_address_extract(spark: SparkSession, path: str) -> DataFrame:
    """Extract lines ``id lon lat`` then tab-parted street, number, postcode, city.

    Lines that do not start with a digit are headers. The source id is kept.
    """
    line = r"^\s*(\S+)\s+(\S+)\s+(\S+)(?:\s+(.*))?$"
    rows = spark.read.text(path).where(F.substring("value", 1, 1).rlike("[0-9]"))
    part = [F.regexp_extract("value", line, i) for i in range(1, 5)]
    fields = F.split(part[3], "\t")
    def field(i: int) -> Column:
        return F.coalesce(F.ltrim(F.get(fields, F.lit(i))), F.lit(""))
    out = rows.select(
        part[0].alias("id"), part[2].try_cast("double").alias("lat"), part[1].try_cast("double").alias("lon"),
        field(0).alias("street"), field(1).alias("house_number"), field(2).alias("postcode"), field(3).alias("city"),
    )
    return out.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def read_regions(spark: SparkSession, path: str, level: int | None = 2, crs: str = "3857") -> DataFrame:
    """Regions of a GeoJSON feature collection as polygons in Mercator metres.

    Property names vary by source. Features without code or polygon are
    skipped. ``level`` 2 keeps level-2 regions by property, else by codes of
    four characters, else everything.
    """
    doc = spark.read.option("multiLine", True).schema(
        "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    ).json(path)
    f = doc.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")
    def prop(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at("properties", F.lit(n)), F.lit("")) for n in names])
    poly = F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    multi = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    raw = F.when(F.col("geometry.type") == "Polygon", poly).when(F.col("geometry.type") == "MultiPolygon", multi)
    def point(p: Column) -> Column:
        x, y = p[0], p[1]
        if crs != "3857":
            x, y = geo.mercator_x(x), geo.mercator_y(y)
        return F.struct(x.alias("x"), y.alias("y"))
    shaped = F.transform("_raw", lambda pol: F.transform(pol, lambda ring: F.transform(ring, point)))
    out = f.select(
        prop("id", "NUTS_ID").alias("code"), prop("CNTR_CODE", "country_code", "co").alias("country_code"),
        prop("na", "NUTS_NAME", "NAME_LATN", "name_latn").alias("name_latn"), prop("LEVL_CODE").try_cast("int").alias("level"), raw.alias("_raw"),
    ).where(F.col("code").isNotNull() & F.col("_raw").isNotNull() & (F.size("_raw") > 0))
    out = out.withColumn("polygons", shaped).drop("_raw")
    if level is None:
        return out
    if not out.where(F.col("level").isNotNull()).limit(1).isEmpty():
        return level_two(out)
    coded = level_two(out.drop("level"))
    return coded if not coded.limit(1).isEmpty() else out.drop("level")


def rings_as_degrees(regions: DataFrame) -> DataFrame:
    """Region rings in WGS84: code, part, ring, pos, lat, lon."""
    rings = regions.select("code", F.posexplode("polygons").alias("part", "_p")).select("code", "part", F.posexplode("_p").alias("ring", "_r"))
    pts = rings.select("code", "part", "ring", F.posexplode("_r").alias("pos", "_q"))
    return pts.select("code", "part", "ring", "pos", geo.lat_of_mercator("_q.y").alias("lat"), geo.lon_of_mercator("_q.x").alias("lon"))


def read_region_counts(spark: SparkSession, path: str) -> DataFrame:
    """Region counts CSV; rows without code or whole count are skipped."""
    df = _csv(spark, path, ["nuts_region_code", "address_count"], False)
    out = df.select(_text("nuts_region_code").alias("region"), F.trim("address_count").try_cast("bigint").alias("address_count"))
    return out.where(F.col("region").isNotNull() & F.col("address_count").isNotNull())


def read_osm(spark: SparkSession, folder: str) -> Osm:
    """Element tables exported as Parquet: nodes, ways, relations."""
    def table(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(os.path.join(folder, name))
    return Osm(table("nodes", NODE_SCHEMA), table("ways", WAY_SCHEMA), table("relations", RELATION_SCHEMA))
