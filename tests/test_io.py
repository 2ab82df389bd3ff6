import datetime as dt
import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from terraloom.operators import reports as RP
from terraloom.operators.regions import build_cover, combine_regions, region_dimension
from terraloom.sources import readers as RD
from terraloom.sources import writers as WR
from terraloom.streaming import jobs as ST


def test_address_csv(spark, tmp_path):
    f = tmp_path / "a.csv.gz"
    with gzip.open(f, "wt") as h:
        h.write("id,lat,lon,street,house_number,postcode,city,nuts_region_code\n"
                '1, 52.1 ,5.1,"Main, north",1,1234,Town,NL31\n,52,5,x,1,1,c,NL31\n2,north,5,x,1,1,c,NL31\n3,52,5, ,,,,\n')
    got = {r.id: r for r in RD.read_addresses(spark, str(f)).collect()}
    assert set(got) == {"1", "3"} and got["1"].street == "Main, north" and got["1"].lat == 52.1
    assert got["3"].street is None and got["3"].region is None
    assert RD.with_location_text(RD.read_addresses(spark, str(f)).where("id = '1'")).first().location == "POINT(5.1 52.1)"
    bad = tmp_path / "b.csv"
    bad.write_text("id,lat\n1,2\n")
    with pytest.raises(ValueError):
        RD.read_addresses(spark, str(bad))


def test_buildings_and_tags(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text('id,is_building,is_addr,is_relation,is_node,is_way,lat,lon,city,tags\n'
                 '1,1,0,0,1,0,52.0,5.0,"A ""b"" c","{""building"":""house"",""addr:city"":""x"",""name"":""n""}"\n2,1,0,0,1,0,52.0,5.0,,not json\n')
    df = RD.read_buildings(spark, str(f))
    rows = {r.id: r for r in df.collect()}
    assert rows[1].city == 'A "b" c' and rows[1].is_building == 1
    assert RD.read_buildings(spark, str(f), max_rows=1).count() == 1
    assert RD.with_tag_map(df).where("id = 1").first().tags["building"] == "house"
    tags = {(r.tag, r.rows) for r in RP.tag_counts(df.withColumn("region", F.lit("R")), by_region=False).collect()}
    assert tags == {("building=house", 1), ("name", 1)}


def test_extract_lines(spark, tmp_path):
    f = tmp_path / "x.txt"
    f.write_text("id lon lat\n12 5.1 52.1 High street\t7\t1234\tTown\n13 5.2 52.2\n14 a b\n\n")
    got = {r.id: r for r in RD.read_address_extract(spark, str(f)).collect()}
    assert set(got) == {"12", "13"} and got["12"].street == "High street" and got["12"].city == "Town" and got["13"].street == ""


def test_regions_geojson(spark, tmp_path):
    sq = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]
    feats = [
        {"properties": {"NUTS_ID": "NL31", "CNTR_CODE": "NL", "NAME_LATN": "Utrecht", "LEVL_CODE": 2}, "geometry": {"type": "Polygon", "coordinates": sq}},
        {"properties": {"id": "UK01", "CNTR_CODE": "UK", "na": "North", "LEVL_CODE": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [sq, sq]}},
        {"properties": {"NUTS_ID": "NL", "CNTR_CODE": "NL", "NAME_LATN": "All", "LEVL_CODE": 0}, "geometry": {"type": "Polygon", "coordinates": sq}},
        {"properties": {"NUTS_ID": ""}, "geometry": {"type": "Polygon", "coordinates": sq}},
        {"properties": {"NUTS_ID": "P", "LEVL_CODE": 2}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    f = tmp_path / "r.geojson"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": feats}, indent=1))
    r = RD.read_regions(spark, str(f))
    got = {x.code: x for x in r.collect()}
    assert set(got) == {"NL31", "UK01"} and got["UK01"].name_latn == "North" and len(got["UK01"].polygons) == 2
    assert RD.read_regions(spark, str(f), level=None).count() == 3
    assert {x.code for x in combine_regions(r.where("code = 'NL31'"), r).collect()} == {"NL31", "UK01"}
    assert region_dimension(r).count() == 2
    ring = RD.rings_as_degrees(r.where("code = 'NL31'")).orderBy("pos").first()
    assert abs(ring.lat) < 1e-9 and abs(ring.lon) < 1e-9


def test_counts_csv_and_osm(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("nuts_region_code,address_count\nA,10\nB,many\n,5\n")
    assert [(r.region, r.address_count) for r in RD.read_region_counts(spark, str(f)).collect()] == [("A", 10)]
    for name, schema, row in (("nodes", RD.NODE_SCHEMA, (1, 1.0, 1.0, {})), ("ways", RD.WAY_SCHEMA, (1, [1], {})), ("relations", RD.RELATION_SCHEMA, (1, [], {}))):
        spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "osm" / name))
    assert RD.read_osm(spark, str(tmp_path / "osm")).ways.count() == 1


def test_regional_and_flat_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "AB"[i % 2] if i < 8 else None, i / 3) for i in range(10)], "id long, region string, lat double")
    p = str(tmp_path / "r")
    assert {r.region: r.rows for r in WR.write_by_region(df, p, rows_per_file=2).collect()} == {"A": 4, "B": 4}
    assert {r.id for r in WR.read_region(spark, p, "A").collect()} == {0, 2, 4, 6}
    with pytest.raises(ValueError):
        WR.read_region(spark, p, "Z")
    WR.write_flat(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 10
    WR.write_csv_gz(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("id = 1").first().lat == "0.3333333"


def test_short_files_do_not_make_tasks(spark, tmp_path):
    import glob
    import os

    import pyarrow.parquet as pq

    path = str(tmp_path / "short")
    df = spark.range(2000).select("id", F.format_string("R%d", F.col("id") % 3).alias("region"), (F.col("id") / 100.0).alias("lat"), (F.col("id") / 50.0).alias("lon"))
    WR.write_by_region(df, path, rows_per_file=10)
    files = glob.glob(f"{path}/region=*/*.parquet")
    assert len({os.path.basename(f).split("-")[1] for f in files}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(pq.read_metadata(f).num_rows for f in files) <= 10 and len(files) >= 200
    assert {r.id for r in WR.read_region(spark, path, "R1").collect()} == set(range(1, 2000, 3))


def test_box_reads_touch_few_files(spark, tmp_path):
    import glob

    import numpy as np
    import pandas as pd
    import pyarrow.parquet as pq

    g = np.random.default_rng(3)
    p = pd.DataFrame({"id": np.arange(20_000), "region": "A", "lat": 50 + g.random(20_000), "lon": 4 + g.random(20_000)})
    p.loc[:1999, ["lat", "lon"]] = [50.9, 4.9]
    p.loc[19_000:, "region"] = "B"
    p.loc[[5000, 5001], "lat"] = np.nan
    path = str(tmp_path / "box")
    assert {r.region: r.rows for r in WR.write_by_region(spark.createDataFrame(p), path, rows_per_file=500).collect()} == {"A": 19_000, "B": 1000}
    box = (50.2, 4.3, 50.35, 4.45)
    a = p[(p.region == "A") & p.lat.between(50.2, 50.35) & p.lon.between(4.3, 4.45)]
    assert {r.id for r in WR.read_box(spark, path, "A", *box).collect()} == set(a.id)
    groups = touched = 0
    for f in glob.glob(f"{path}/region=A/*.parquet"):
        m = pq.ParquetFile(f).metadata
        names = [m.schema.column(c).name for c in range(m.num_columns)]
        for k in range(m.num_row_groups):
            (la, lo) = (m.row_group(k).column(names.index(c)).statistics for c in ("lat", "lon"))
            groups += 1
            touched += not la.has_min_max or (la.min <= 50.35 and la.max >= 50.2 and lo.min <= 4.45 and lo.max >= 4.3)
    assert groups >= 30 and touched <= groups / 5


def test_stored_tables_are_replaced_whole(spark, tmp_path):
    """The old table stays when writing the new one fails, and nothing is left beside it."""
    import os

    path = str(tmp_path / "kept")
    WR.reload(spark.createDataFrame([(1, "a")], "id long, v string"), path)
    bad = spark.createDataFrame([(2, "b")], "id long, v string").select(F.raise_error(F.lit("broken")).cast("long").alias("id"), "v")
    with pytest.raises(Exception, match="broken"):
        WR._replace(bad, path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "a")]
    WR.upsert(spark.createDataFrame([(1, "z"), (3, "c")], "id long, v string"), path, "id")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "z"), (3, "c")}
    WR.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0 and not [n for n in os.listdir(tmp_path) if ".old-" in n]


def test_append_upsert_reload(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    assert WR.append_new(a, p, "id", "v") == 2
    assert WR.append_new(spark.createDataFrame([(2, "x"), (3, "y")], "id long, v string"), p, "id", "v") == 1
    assert {(r.id, r.v) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "c"), (3, "y")}
    n = WR.upsert(spark.createDataFrame([(1, "a"), (2, "new"), (9, "z")], "id long, v string"), p, "id")
    assert n == {"inserted": 1, "updated": 1, "unchanged": 1}
    assert {(r.id, r.v) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "new"), (3, "y"), (9, "z")}
    assert WR.reload(a, p).count() == 3
    WR.truncate(spark, p)
    assert spark.read.schema("id long, v string").parquet(p).isEmpty()


def staged(df, late, path):
    """One file of rows, then a later file that moves the watermark."""
    df.coalesce(1).write.parquet(path)
    time.sleep(1.2)
    late.coalesce(1).write.mode("append").parquet(path)
    return path


def drain(df, name, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_windows_stream_equals_batch(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    late = ev.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    src = staged(ev, late, str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    cols = ["window_start", "event_type", "events"]
    for i, kw in enumerate(({}, {"slide": "30 minutes"}, {"gap": "15 minutes"})):
        got = drain(ST.windowed_counts(stream, **kw), f"w{i}", tmp_path).select(cols).where("window_start < '2029-01-01'")
        want = ST.windowed_counts(ev, **kw).select(cols)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_tag_stream(spark, tmp_path):
    sq = [[[{"x": x, "y": y} for x, y in ((0.0, 0.0), (1e6, 0.0), (1e6, 1e6), (0.0, 1e6))]]]
    cover = build_cover(spark.createDataFrame([("A", sq)], "code string, polygons array<array<array<struct<x:double,y:double>>>>"))
    pts = spark.createDataFrame([(1, 3.0, 3.0), (2, 30.0, 3.0)], "id long, lat double, lon double")
    pts.write.parquet(str(tmp_path / "p"))
    s = ST.tag_stream(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "p")), cover)
    q = s.writeStream.format("memory").queryName("tags").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: r.region for r in spark.table("tags").collect()} == {1: "A", 2: None}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_settle_stream(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        settled(spark, tmp_path, zone.replace("/", "_"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def settled(spark, tmp_path, zone):
    t0 = dt.datetime(2024, 1, 1, 12)
    schema = "employee_id long, active_id long, start_time timestamp, duration_s double, reward double, xp long"
    rows = [(1, 1, t0, 60.0, 5.0, 10), (1, 1, t0, 60.0, 5.0, 10), (1, 2, t0, 1e7, 7.0, 1), (2, 3, t0, 3600.0, 2.0, 4)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    late = spark.createDataFrame([(9, 9, t0 + dt.timedelta(hours=5), 1e9, 0.0, 0)], schema)
    src = staged(spark.createDataFrame(rows, schema), late, str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    done = {(r.active_id, r.completed_at) for r in drain(ST.settle_stream(stream), f"settled_{zone}", tmp_path).collect()}
    assert done == {(1, t0 + dt.timedelta(seconds=60)), (3, t0 + dt.timedelta(hours=1))}


def test_settlement_calls_state_once_per_arrival():
    """Calls to the state don't grow with the jobs that arrive together."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.held, self.timers, self.calls = [], [], 0

        def getListState(self, name, schema):
            return self

        def registerTimer(self, ms):
            self.timers.append(ms)
            self.calls += 1

        def appendList(self, jobs):
            self.held += jobs
            self.calls += 1

        def put(self, jobs):
            self.held = list(jobs)
            self.calls += 1

        def get(self):
            return iter(self.held)

        def clear(self):
            self.held = []

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        def getExpiryTimeInMs(self):
            return self.ms

    h, p = Handle(), ST._Settle()
    p.init(h)
    n = 100
    rows = pd.DataFrame({"active_id": range(n), "start_us": 0, "duration_s": [1.0 + i for i in range(n)], "reward": 1.0, "xp": 1})
    assert list(p.handleInputRows((7,), iter([rows]), None)) == []
    assert h.calls == 2 and h.timers == [1000]
    (out,) = p.handleExpiredTimer((7,), At(50_500), At(1000))
    assert list(out.active_id) == list(range(50)) and set(out.employee_id) == {7}
    assert h.timers[-1] == 51_000 and len(h.held) == 50
    (out,) = p.handleExpiredTimer((7,), At(10**9), At(51_000))
    assert list(out.active_id) == list(range(50, n)) and not h.held
