import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import spatial


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("points, metres", [((16.0544, 108.2022, 16.0610, 108.2212), 2158.8), ((1.0, 2.0, 1.0, 2.0), 0.0), ((None, 1.0, 1.0, 1.0), None), ((95.0, 1.0, 1.0, 1.0), None), ((1.0, 185.0, 1.0, 1.0), None), ((float("nan"), 1.0, 1.0, 1.0), None)])
def test_haversine(spark, points, metres):
    assert one(spark, geo.haversine(*[F.lit(p).cast("double") for p in points])) == metres


@pytest.mark.parametrize("lat, lng, inside", [(16.0612, 108.2272, True), (15.8778, 108.3283, True), (15.5684, 108.4816, True), (21.0285, 105.8542, False), (10.7769, 106.7009, False), (None, 108.0, False)])
def test_service_area(spark, lat, lng, inside):
    assert one(spark, geo.in_service_area(F.lit(lat).cast("double"), F.lit(lng).cast("double"))) is inside


@pytest.mark.parametrize("verified, total, penalty", [(9, 10, 0.0), (5, 10, 5.0), (5, 22, 5.0), (80, 100, 0.0), (60, 100, 2.5), (None, None, 0.0), (0, 0, 0.0)])
def test_confidence(spark, verified, total, penalty):
    assert one(spark, geo.confidence_penalty(F.lit(verified).cast("long"), F.lit(total).cast("long"))) == penalty


@pytest.mark.parametrize("metres, minutes", [(0.0, 1), (15.4, 1), (77.0, 1), (112.5, 2), (750.0, 10)])
def test_walking(spark, metres, minutes):
    assert one(spark, geo.walking_minutes(F.lit(metres))) == minutes


def test_nearest(spark):
    places = spark.createDataFrame([("s1", "verified", 16.0550, 108.2025), ("s2", "unresolved", 16.0548, 108.2024), ("s3", "verified", 16.0650, 108.2025), ("s4", "verified", 16.0580, 108.2025), ("s5", "verified", None, 108.2025)], "place_id string, status string, lat double, lng double").where("status = 'verified'")
    at = spark.createDataFrame([(1, 16.0544, 108.2022), (2, None, 1.0)], "query_id long, q_lat double, q_lng double")
    find = lambda r, k: [(x["place_id"], x["metres"]) for x in spatial.nearest(at, places, "query_id", "place_id", r, k, ("q_lat", "q_lng"), ("lat", "lng")).orderBy("rank").collect()]
    assert find(1000.0, 10) == [("s1", 74.0), ("s4", 401.6)]
    assert find(2000.0, 1) == [("s1", 74.0)]
    assert [p for p, _ in find(2000.0, 10)] == ["s1", "s4", "s3"]


def test_line_geometry(spark):
    points = spark.createDataFrame([("a", i, 16.0 + i / 100, 108.0) for i in range(5)], "line string, at int, lat double, lng double")
    found = spatial.lengths(points, "line", "at").first()
    assert found["n_points"] == 5 and abs(found["metres"] - 4447.8) < 0.1
    anchors = spark.createDataFrame([("a", 1, 16.005, 108.001), ("a", 2, 16.04, 108.0)], "line string, anchor int, a_lat double, a_lng double")
    near = {r["anchor"]: r for r in spatial.onto_line(anchors, spatial.segments(points, "line", "at"), "line", "anchor").collect()}
    assert abs(near[1]["metres_off"] - 107.0) < 0.1 and abs(near[1]["progress"] - 0.125) < 1e-6 and near[2]["progress"] == pytest.approx(1.0)


def test_vertices(spark):
    points = F.array(*[F.struct(F.lit(float(i)).alias("lat"), F.lit(0.0).alias("lng")) for i in (0, 1, 1, 3)])
    assert one(spark, spatial.nearest_vertex(points, F.lit(1.2), F.lit(0.0))) == 1
    assert one(spark, spatial.nearest_vertex(F.lit(None).cast("array<struct<lat:double,lng:double>>"), F.lit(1.2), F.lit(0.0))) == 0
    assert len(one(spark, spatial.between_vertices(points, F.lit(1), F.lit(3)))) == 3
    assert one(spark, spatial.between_vertices(points, F.lit(3), F.lit(1))) is None


@pytest.mark.parametrize("lat, street, name", [(16.05, "Lê Duẩn", "Đà Nẵng"), (15.88, "Cửa Đại", "Hội An"), (15.7, "Núi Thành", "Tam Kỳ"), (15.6, None, "Tam Kỳ"), (15.8, "x", "Quảng Nam"), (None, "Hội An", "Đà Nẵng")])
def test_localities(spark, lat, street, name):
    found = spark.range(1).select(geo.locality(F.lit(lat).cast("double"), F.lit(street).cast("string")).alias("x")).first()["x"]
    assert found.startswith(name)


def test_bounds(spark):
    rows = spark.createDataFrame([(16.0, 108.0), (15.5, 108.5), (None, 1.0), (99.0, 0.0)], "lat double, lng double")
    assert tuple(rows.agg(*geo.bounds()).first()) == (15.5, 108.0, 16.0, 108.5)
