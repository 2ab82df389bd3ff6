import pytest
from pyspark.sql import functions as F

from terraloom.functions import geo, levels
from terraloom.functions import tags as T
from terraloom.functions.hashing import unit_hash


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_mercator_origin_and_back(spark):
    r = one(spark, geo.mercator_x(0.0), geo.mercator_y(0.0), geo.lat_of_mercator(geo.mercator_y(52.3)), geo.lon_of_mercator(geo.mercator_x(4.9)))
    assert abs(r[0]) < 1e-9 and abs(r[1]) < 1e-9
    assert r[2] == pytest.approx(52.3) and r[3] == pytest.approx(4.9)


def test_thousandth_of_a_degree(spark):
    r = one(spark, geo.haversine_m(0.0, 0.0, 0.0, 0.001), geo.haversine_m(5.0, 5.0, 5.0, 5.0), geo.great_circle_km(52.0907, 5.1214, 52.086, 5.1207))
    assert 90 < r[0] < 140 and r[1] == 0 and 0 < r[2] < 1


def test_destination_goes_the_distance(spark):
    lat, lon = geo.destination(52.0, 5.0, 10.0, 1.0)
    assert one(spark, geo.great_circle_km(52.0, 5.0, lat, lon))[0] == pytest.approx(10.0, abs=1e-9)


def test_levels(spark):
    t = levels.thresholds()
    assert t[1] == 75 and len(t) == 121
    assert t[99] == pytest.approx(13_034_431, rel=1e-4) and t[120] == pytest.approx(104_273_167, rel=1e-4)
    rows = spark.createDataFrame([(x,) for x in (-5, 0, 74, 75, 100, t[120], t[120] + 9)], "xp long").select(levels.level_of("xp"), levels.xp_to_next("xp"), levels.percent_to_next("xp")).collect()
    assert [r[0] for r in rows] == [0, 0, 0, 1, 1, 120, 120]
    assert rows[2][1] == 1 and rows[-1][1] == 0 and rows[-1][2] == 100.0


@pytest.mark.parametrize("rule,expected", [
    ("leading", [50.0, 48.28032, 48.28032, 50.0, None, None, None, None]),
    ("token", [50.0, 48.28032, None, 50.0, None, None, None, 0.0]),
])
def test_posted_speed(spark, rule, expected):
    texts = ["50", "30 mph", "30mph", "50 km/h", "none", "walk", "", "0"]
    df = spark.createDataFrame([(i, {"maxspeed": t}) for i, t in enumerate(texts)], "id int, tags map<string,string>")
    got = [r[0] for r in df.orderBy("id").select(T.posted_kmh("tags", rule)).collect()]
    assert got == [pytest.approx(e) if e is not None else None for e in expected]


def test_hash_does_not_depend_on_partitions(spark):
    a = spark.range(500).select("id", unit_hash("id", 3).alias("h"))
    b = spark.range(500).repartition(7).select("id", unit_hash("id", 3).alias("h"))
    assert a.exceptAll(b).isEmpty()
    assert a.where("h < 0 or h >= 1").isEmpty()
    assert 0.4 < a.agg(F.avg("h")).first()[0] < 0.6


def test_sorted_json(spark):
    df = spark.createDataFrame([({"z": "1", "a": 'x"y'},)], "tags map<string,string>")
    assert df.select(T.sorted_json("tags")).first()[0] == '{"a":"x\\"y","z":"1"}'
