"""Queries that write tables to shared scratch and read them back, and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generation as GN
from ..operators import progression as PG
from ..operators import regions as RG
from ..operators import reports as RP
from ..scratch import cut, scratch_root
from ..sources import readers as RD
from ..sources import writers as WR
from ..streaming import jobs as ST
from . import derive as D
from .logistics import ELIG, UPG, UPS, upsert_tables
from .oracle import with_
from .registry import query
from .spatial import IN_BOX, tagged


def place(spark: SparkSession, name: str) -> str:
    """A fresh folder for one written table."""
    return os.path.join(scratch_root(spark), "stored", spark.sparkContext.applicationId, uuid.uuid4().hex, name)


def located_addresses(spark, sf) -> DataFrame:
    return tagged(spark, sf, how="inner").select("id", "lat", "lon", "city", "region")


TAGGED = f"SELECT id, lat, lon, city, {IN_BOX} AS region FROM addr WHERE {IN_BOX} IS NOT NULL"


@query("address_csv", with_("addr", f"SELECT CAST(id AS VARCHAR) AS id, round(lat, 4) AS lat, round(lon, 4) AS lon, city, region FROM ({TAGGED})"))
def _(spark, sf):
    path = place(spark, "addresses.csv.gz")
    WR.write_csv_gz(located_addresses(spark, sf).withColumnRenamed("region", "nuts_region_code"), path, decimals=None)
    return RD.read_addresses(spark, path).select("id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "city", "region")


@query("building_csv", "SELECT p_partkey AS id, CAST(p_partkey % 2 AS INTEGER) AS is_building, p_brand AS city, p_type AS building FROM part")
def _(spark, sf):
    path = place(spark, "buildings.csv.gz")
    p = D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2).alias("is_building"), F.lit(52.0).alias("lat"), F.lit(5.0).alias("lon"),
        F.col("p_brand").alias("city"), F.to_json(F.create_map(F.lit("building"), F.col("p_type"))).alias("tags"))
    WR.write_csv_gz(p, path)
    back = RD.with_tag_map(RD.read_buildings(spark, path))
    return back.select("id", "is_building", "city", F.col("tags")["building"].alias("building"))


@query("address_extract_text", with_("addr", "SELECT CAST(id AS VARCHAR) AS id, round(lat, 4) AS lat, round(lon, 4) AS lon, city FROM addr"))
def _(spark, sf):
    path = place(spark, "extract.txt")
    a = D.addresses(spark, sf)
    line = F.concat_ws(" ", F.col("id").cast("string"), F.format_string("%.9f", "lon"), F.format_string("%.9f", "lat"),
                       F.concat_ws("\t", F.lit("Street"), F.lit("1"), F.lit("1000"), F.col("city")))
    a.select(line.alias("value")).unionByName(spark.range(1).select(F.lit("id lon lat").alias("value"))).write.text(path)
    return RD.read_address_extract(spark, path).select("id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "city")


@query("regions_geojson", "SELECT 'R' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, r_name AS country_code, n_name AS name_latn, 2 AS rings FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    path = place(spark, "regions.geojson")
    ring = F.transform(F.col("polygons")[0], lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    props = F.create_map(F.lit("id"), F.col("code"), F.lit("CNTR_CODE"), F.col("country_code"), F.lit("na"), F.col("name_latn"), F.lit("LEVL_CODE"), F.lit("2"))
    feature = F.struct(props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    # One document by nature of the format: a region dimension.
    D.regions(spark, sf).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).write.text(path)
    back = RD.read_regions(spark, path)
    return back.select("code", "country_code", "name_latn", F.size(F.col("polygons")[0]).alias("rings"))


@query("region_counts_csv", with_("addr", f"SELECT region, count(*) AS address_count FROM ({TAGGED}) GROUP BY 1"))
def _(spark, sf):
    path = place(spark, "counts.csv")
    WR.write_report(RP.region_counts(located_addresses(spark, sf)).withColumnRenamed("region", "nuts_region_code"), path)
    return RD.read_region_counts(spark, path)


@query("regional_parquet", with_("addr", f"SELECT id, round(lat, 6) AS lat, city FROM ({TAGGED}) WHERE region = 'R07'"))
def _(spark, sf):
    path = place(spark, "regional")
    WR.write_by_region(located_addresses(spark, sf), path, rows_per_file=20)
    return WR.read_region(spark, path, "R07").select("id", F.round("lat", 6).alias("lat"), "city")


@query("regional_parquet_rows", with_("addr", f"SELECT region, count(*) AS rows FROM ({TAGGED}) GROUP BY 1"))
def _(spark, sf):
    return WR.write_by_region(located_addresses(spark, sf), place(spark, "regional"))


@query("generation_stored", "SELECT c_custkey AS id, c_custkey % 3 <> 0 AS is_new FROM customer")
def _(spark, sf):
    """One run for a third of the addresses, a dry run, and one for the rest."""
    from .logistics import RANGES, addr_points, straight
    a, folder = addr_points(spark, sf), place(spark, "generated")
    jobs, rejects = (os.path.join(folder, n) for n in ("jobs", "rejects"))
    first = a.where("id % 3 = 0")
    GN.run_generation(first, None, straight, folder, "all", seed=1, method="linear", ranges=RANGES)
    stored = spark.read.parquet(jobs)
    done = stored.select("start_address").unionByName(spark.read.parquet(rejects).select(F.col("id").alias("start_address")))
    done = cut(done)
    if GN.run_generation(a, done, straight, folder, dry_run=True)["addresses"] != a.count() - done.count() or stored.count() != spark.read.parquet(jobs).count():
        raise RuntimeError("a dry run wrote or counted wrongly")
    GN.run_generation(a, done, straight, folder, seed=2, method="linear", ranges=RANGES)
    every = spark.read.parquet(jobs).select(F.col("start_address").alias("id")).unionByName(spark.read.parquet(rejects).select("id"))
    old = done.select(F.col("start_address").alias("id"), F.lit(False).alias("was"))
    return every.join(old, "id", "left").select("id", F.coalesce("was", F.lit(True)).alias("is_new"))


@query("flat_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    path = place(spark, "flat")
    WR.write_flat(D.table(spark, sf, "orders"), path)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice")


@query("append_stored", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS batch FROM customer")
def _(spark, sf):
    path = place(spark, "appended")
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    WR.append_new(c.where("id % 3 = 0").withColumn("batch", F.lit("first")), path, "id")
    WR.append_new(c.withColumn("batch", F.lit("second")), path, "id")
    return spark.read.parquet(path)


@query("upsert_stored", "WITH " + UPS + " SELECT id, name FROM n")
def _(spark, sf):
    path = place(spark, "dimension")
    new, old = upsert_tables(spark, sf)
    WR.upsert(old, path, "id")
    WR.upsert(new, path, "id")
    return spark.read.parquet(path).select("id", "name")


@query("reload_stored", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1")
def _(spark, sf):
    path = place(spark, "reloaded")
    s = D.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    WR.reload(s, path)
    WR.truncate(spark, path)
    return WR.reload(s.where("s_suppkey % 2 = 1"), path)


@query("upgrade_order", with_("ugame", "SELECT").removesuffix(" SELECT") + ", " + UPG + ", " + ELIG +
       "SELECT game_id, upgrade_id, row_number() OVER (PARTITION BY game_id ORDER BY starts_with(upgrade_id, 'unlock_') DESC, (len(req) = 0 AND levels_met AND money >= cost) DESC, "
       "(len(req) = 0 AND levels_met) DESC, cost, upgrade_id) AS place FROM el")
def _(spark, sf):
    from pyspark.sql import Window as W

    e = PG.upgrade_eligibility(D.user_games(spark, sf), PG.upgrade_table(spark))
    at = F.row_number().over(W.partitionBy("game_id").orderBy(*PG.upgrade_order()))
    return e.select("game_id", "upgrade_id", at.cast("long").alias("place"))


def _drained(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Rows of a stream that has taken all its input, from a written table."""
    out, marks = place(spark, name), place(spark, name + "_marks")
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("tag_stream", with_("addr", f"SELECT id, region FROM ({TAGGED})"))
def _(spark, sf):
    a = D.addresses(spark, sf)
    path = place(spark, "arriving")
    a.write.parquet(path)
    stream = spark.readStream.schema(a.schema).parquet(path)
    return _drained(ST.tag_stream(stream, RG.build_cover(D.regions(spark, sf)), how="inner").select("id", "region"), spark, "tagged")


STARTS = "SELECT employee_id, active_id, reward, xp, start_time, duration_s FROM active WHERE start_time IS NOT NULL"


@query("settle_stream", with_("active", f"SELECT employee_id, active_id, reward, xp, epoch_us(start_time) + CAST(round(duration_s * 1e6) AS BIGINT) AS completed_us FROM ({STARTS})"))
def _(spark, sf):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        a = D.active(spark, sf).where("start_time is not null").select(
            "employee_id", "active_id", F.col("start_time").cast("timestamp").alias("start_time"), "duration_s", "reward", "xp")
        # All jobs in one batch of files; one far later start moves the clock
        # past every due time.
        first = place(spark, "starts")
        a.write.parquet(first)
        files = len(spark.read.parquet(first).inputFiles())
        last = a.limit(1).select(F.lit(-1).cast("long").alias("employee_id"), F.lit(-1).cast("long").alias("active_id"),
                                 F.lit("2100-01-01").cast("timestamp").alias("start_time"), F.lit(1e9).alias("duration_s"), "reward", "xp")
        last.write.mode("append").parquet(first)
        stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", files).parquet(first)
        done = ST.settle_stream(stream).select("employee_id", "active_id", "reward", "xp", F.unix_micros("completed_at").alias("completed_us"))
        return _drained(done, spark, "settled")
    finally:
        spark.conf.set(provider, before)
