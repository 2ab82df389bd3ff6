"""Map and logistics tables derived from the star-schema test tables.

Every derivation uses all rows of its source table. The same definitions are
kept as SQL in ``oracle.py``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.hashing import unit_hash
from ..operators.elements import Osm
from ..operators.progression import upgrade_rows
from ..operators.ways import routable
from ..scratch import cut, spread

AS_OF_TEXT = "2024-01-20 00:00:00"
WAY_HIGHWAYS = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "residential",
    "service", "footway", "cycleway", "platform", "motorway_link", "steps",
]
WAY_SPEEDS = ["50", "30 mph", "30mph", "none", "50 km/h", "walk"]


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def at(key) -> tuple[Column, Column]:
    """Position of a whole-number key."""
    k = F.col(key) if isinstance(key, str) else key
    lat = F.lit(50.0) + F.lit(3.0) * ((k * 7919) % 10007) / F.lit(10007.0)
    lon = F.lit(3.0) + F.lit(5.0) * ((k * 104729) % 10009) / F.lit(10009.0)
    return lat, lon


def located(df: DataFrame, key, lat: str = "lat", lon: str = "lon") -> DataFrame:
    a, b = at(key)
    return df.withColumn(lat, a).withColumn(lon, b)


def addresses(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("city"))
    return located(c, "id")


def regions(spark, sf) -> DataFrame:
    """A box with a square hole per nation, in Mercator metres."""
    n = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    lat0 = F.lit(50.0) + F.lit(0.6) * F.floor(F.col("n_nationkey") / 5)
    lon0 = F.lit(3.0) + F.col("n_nationkey") % 5

    def ring(s, w, n_, e) -> Column:
        def p(la, lo):
            return F.struct(geo.mercator_x(lo).alias("x"), geo.mercator_y(la).alias("y"))
        return F.array(p(s, w), p(s, e), p(n_, e), p(n_, w))

    outer = ring(lat0, lon0, lat0 + 0.6, lon0 + 1.0)
    hole = ring(lat0 + 0.2, lon0 + 0.4, lat0 + 0.4, lon0 + 0.6)
    return n.select(
        F.concat(F.lit("R"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
        F.col("r_name").alias("country_code"), F.col("n_name").alias("name_latn"),
        F.array(F.array(outer, hole)).alias("polygons"),
    )


def box_code(lat="lat", lon="lon") -> Column:
    """Region code of the box a point lies in, holes ignored."""
    n = F.floor((F.col(lat) - 50.0) / F.lit(0.6)) * 5 + F.floor(F.col(lon) - 3.0)
    return F.concat(F.lit("R"), F.lpad(n.cast("long").cast("string"), 2, "0"))


def region_addresses(spark, sf) -> DataFrame:
    """Addresses with their box's code."""
    return addresses(spark, sf).withColumn("region", box_code())


def _pick(items: list[str], no: Column) -> Column:
    return F.get(F.array(*[F.lit(i) for i in items]), no.cast("int"))


def _tags(**kv: Column) -> Column:
    entries = F.array(*[F.struct(F.lit(k.replace("__", ":")).alias("k"), v.cast("string").alias("v")) for k, v in kv.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def way_refs(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    node = F.col("l_partkey") * 100 + (F.col("l_suppkey") * 7 + F.col("l_quantity")).cast("long") % 100
    rows = F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "ref"))
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", node.alias("ref"))
    return spread(li, li.count(), "l_orderkey").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.transform(F.array_sort(rows), lambda r: r["ref"]).alias("refs")
    )


def ways(spark, sf, refs: DataFrame | None = None) -> DataFrame:
    o = table(spark, sf, "orders")
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    road = status != "F"
    tags = _tags(
        highway=F.when(road, _pick(WAY_HIGHWAYS, k % 12)),
        access=F.when(status == "P", F.when(k % 4 == 0, "private")),
        maxspeed=F.when(road, _pick(WAY_SPEEDS, k % 7)),
        oneway=F.when(road & (k % 5 == 0), "yes").when(road & (k % 5 == 1), "-1"),
        building=F.when(~road, F.when(k % 2 == 0, "house").otherwise("warehouse")),
        addr__city=F.when(~road, F.col("o_orderpriority")),
    )
    return (way_refs(spark, sf) if refs is None else refs).join(o.select(k.alias("id"), tags.alias("tags")), "id")


def nodes(spark, sf, refs: DataFrame | None = None) -> DataFrame:
    ids = (way_refs(spark, sf) if refs is None else refs).select(F.explode("refs").alias("id"))
    ids = spread(ids, table(spark, sf, "lineitem").count(), "id").distinct()
    p = table(spark, sf, "part")
    kind = F.col("p_size") % 4
    tags = _tags(
        shop=F.when(kind == 0, "clothes"), amenity=F.when(kind == 1, "cafe"),
        building=F.when(kind == 2, "house"), addr__street=F.when(kind == 2, F.col("p_name")),
        addr__city=F.when(kind == 2, F.col("p_brand")),
        office=F.when(kind == 3, F.col("p_type")), power=F.when(kind == 3, "generator"),
    )
    tagged = ids.withColumn("pk", F.floor(F.col("id") / 100).cast("long")).join(
        p.select(F.col("p_partkey").alias("pk"), tags.alias("tags")), "pk"
    )
    return located(tagged, "id").select("id", "lat", "lon", "tags")


def relations(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    member = F.struct(
        F.lit("way").alias("type"), F.col("o_orderkey").alias("ref"),
        F.when(F.col("o_orderkey") % 3 == 0, "inner").otherwise("outer").alias("role"),
    )
    m = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    tags = _tags(building=F.lit("apartments"), addr__city=F.col("c_mktsegment"))
    return m.join(c.select(F.col("c_custkey").alias("id"), tags.alias("tags")), "id")


def osm(spark, sf) -> Osm:
    refs = cut(way_refs(spark, sf))
    return Osm(nodes(spark, sf, refs), ways(spark, sf, refs), relations(spark, sf))


def road_ways(spark, sf) -> DataFrame:
    return ways(spark, sf).where(routable("tags"))


def profile_ways(spark, sf) -> DataFrame:
    """Ways of the all-inclusive profile, on which the router drives."""
    return ways(spark, sf).where(routable("tags", "all"))


def customers(spark, sf) -> Column:
    return table(spark, sf, "customer").agg(F.count(F.lit(1))).scalar()


def jobs(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    out = o.select(
        k.alias("job_id"), F.col("o_custkey").alias("start_address"),
        ((F.col("o_custkey") * 31 + 7) % customers(spark, sf)).alias("end_address"),
        (k % 8 + 1).cast("int").alias("tier"), (k % 9).cast("int").alias("category"), (F.col("o_totalprice") / 10000.0).alias("km"),
    )
    lat, lon = at("start_address")
    return out.withColumn("x", geo.mercator_x(lon)).withColumn("y", geo.mercator_y(lat))


def employees(spark, sf) -> DataFrame:
    """One employee per supplier, games are nations."""
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("employee_id"), F.col("s_nationkey").cast("long").alias("game_id"),
        (F.col("s_suppkey") % 14).cast("int").alias("vehicle_level"),
        F.greatest(F.floor(F.col("s_acctbal") * 100), F.lit(0)).cast("long").alias("xp"),
    )
    return located(s, F.col("employee_id") + 5000011)


def active(spark, sf) -> DataFrame:
    """One active job per event; views are offers not started."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    out = e.select(
        k.alias("active_id"), F.col("user_id").alias("employee_id"), (F.col("user_id") % 25).alias("game_id"), (k % 700).alias("job_id"),
        F.when(F.col("event_type") != "view", F.col("ts")).alias("start_time"), (F.col("value") * 3600.0).alias("duration_s"),
        F.col("value").alias("reward"), F.floor(F.col("value") * 10).cast("long").alias("xp"), (k % 9).cast("int").alias("category"),
        (k % customers(spark, sf)).alias("pickup"), ((k * 31 + 7) % customers(spark, sf)).alias("delivery"),
    )
    return located(out, F.col("active_id") + 77, "start_lat", "start_lon")


def event_employees(spark, sf) -> DataFrame:
    u = table(spark, sf, "events").select("user_id").distinct()
    out = u.select(
        F.col("user_id").alias("employee_id"), (F.col("user_id") % 25).alias("game_id"),
        (F.col("user_id") % 14).cast("int").alias("vehicle_level"), (F.col("user_id") * 1000).alias("xp"),
    )
    return located(out, F.col("employee_id") + 5000011)


def event_games(spark, sf) -> DataFrame:
    g = table(spark, sf, "events").select((F.col("user_id") % 25).alias("game_id")).distinct()
    k = F.col("game_id")
    return g.select(
        k, F.lit(1000.0).alias("money"),
        F.create_map(F.lit(0), k * 100, F.lit(3), F.lit(50).cast("long")).alias("xp"),
        F.array().cast("array<string>").alias("upgrades"),
        F.create_map(F.lit("xpMultiplier"), F.lit(1.0) + F.lit(0.25) * (k % 3)).alias("effects"),
    )


def user_games(spark, sf) -> DataFrame:
    """One game per user: money and XP per category from all its events."""
    e = table(spark, sf, "events")
    per = e.groupBy("user_id", (F.col("event_id") % 9).cast("int").alias("c")).agg(
        F.sum(F.floor("value")).cast("long").alias("x"), F.count(F.lit(1)).alias("n")
    )
    return per.groupBy(F.col("user_id").alias("game_id")).agg(
        (F.sum("n") * 400).cast("double").alias("money"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", (F.col("x") * 3000).alias("x"))))).alias("xp"),
    ).withColumn("upgrades", F.array().cast("array<string>")).withColumn("effects", F.create_map().cast("map<string,double>"))


def travel(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'click'")
    out = e.select(
        F.col("event_id").alias("travel_id"), F.col("user_id").alias("employee_id"), F.col("ts").alias("start_time"),
        (F.col("value") * 3600.0).alias("duration_s"),
    )
    return located(out, F.col("travel_id") + 991, "to_lat", "to_lon")


def purchases(spark, sf) -> DataFrame:
    """Upgrade requests: the event number picks the upgrade."""
    e = table(spark, sf, "events")
    ids = [r[0] for r in upgrade_rows()]
    return e.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("game_id"),
        _pick(ids, (F.col("event_id") * 7) % len(ids)).alias("upgrade_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
    )


def route_polyline(spark, sf) -> DataFrame:
    """Stored route points: each order's line items as stops in time."""
    li = table(spark, sf, "lineitem")
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = li.select(
        F.col("l_orderkey").alias("route_id"), (F.row_number().over(w) - 1).alias("seq"),
        F.sum("l_quantity").over(run).alias("cum_time_s"), F.sum(F.floor("l_extendedprice").cast("long")).over(run).alias("cum_dist_m"),
        (F.col("l_partkey") % 100 + 10).cast("double").alias("max_speed_kmh"), (F.col("l_linestatus") == "O").alias("is_walking"),
        F.col("l_partkey").alias("_p"),
    )
    return located(out, F.col("_p") + F.col("seq") * 13).drop("_p")


def lcg(key, seed=0) -> Column:
    return unit_hash(key, seed, "linear")
