import unicodedata

import pytest
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import search
from waymark.plans import places


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, folded", [("Đường Lê Duẩn", "duong le duan"), (None, ""), (unicodedata.normalize("NFD", "Đường Lê Duẩn"), "duong le duan"), ("  Ñandú\n", "nandu")])
def test_fold(spark, given, folded):
    assert one(spark, text.fold(F.lit(given).cast("string"))) == folded


@pytest.mark.parametrize("args, out", [(("flat", 8000, None, None, None), "8.000đ"), (("distance_tiered", None, 8000, 30000, None), "8.000đ - 30.000đ"), (("distance_tiered", None, 15000, 22000, None), "15.000đ - 22.000đ"), ((None, None, None, None, None), "Đang cập nhật"), (("x", None, None, None, 5000), "5.000đ")])
def test_fares(spark, args, out):
    kinds = ["string", "long", "long", "long", "long"]
    assert one(spark, text.fare_text(*[F.lit(a).cast(k) for a, k in zip(args, kinds)])) == out


@pytest.mark.parametrize("args, short, out", [((15, 30, None, None, False, None), False, "15-30 phút"), ((15, 30, None, None, False, None), True, "15-30p"), ((30, 30, None, None, False, None), False, "30 phút"), ((None, None, None, None, True, "theo lịch bay"), False, "Theo lịch bay"), ((None, None, None, None, True, "chuyến bay"), True, "Lịch bay")])
def test_frequencies(spark, args, short, out):
    kinds = ["double", "double", "double", "double", "boolean", "string"]
    assert one(spark, text.frequency_text(*[F.lit(a).cast(k) for a, k in zip(args, kinds)], short=short)) == out


@pytest.mark.parametrize("given, minutes", [("5:15", 315), ("05:15", 315), ("24:00", None), ("12:60", None), ("x", None), (None, None)])
def test_minutes(spark, given, minutes):
    assert one(spark, text.minutes_of(F.lit(given).cast("string"))) == minutes


def test_path_names(spark):
    assert one(spark, text.path_names(F.lit("Lê Duẩn (một chiều) - Hùng Vương → ab -> Lê Duẩn"))) == ["Lê Duẩn", "Hùng Vương"]
    assert one(spark, text.path_names(F.lit(None).cast("string"))) == []


def test_expanded(spark):
    assert one(spark, text.expanded(F.lit("BV. Đà Nẵng, đ Lê12b"))) == "bệnh viện đà nẵng đ lê 12 b"


@pytest.mark.parametrize("given, out", [("Đ/d 12Lê Lợi", "đối diện 12 lê lợi"), ("BXB TT", "bến xe buýt trung tâm"), ("TTHC, CV 29/3", "trung tâm hành chính công viên 29 3"), ("THPT Q1", "trung học phổ thông q 1"), (None, "")])
def test_abbreviations(spark, given, out):
    assert one(spark, text.expanded(F.lit(given).cast("string"))) == out


@pytest.mark.parametrize("given, out", [(("5:15", "21:00"), "05:15 - 21:00"), (("x", "9:5"), "x - 09:05"), ((None, "9:00"), "Đang cập nhật")])
def test_hours_text(spark, given, out):
    assert one(spark, text.hours_text(*[F.lit(x).cast("string") for x in given])) == out


@pytest.mark.parametrize("query, tokens", [("Phố cổ Hội An", ["pho co hoi an", "hoi an"]), ("hoi an", ["hoi an", "pho co hoi an"]), ("Bến xe TT", ["ben xe tt", "ben xe trung tam"]), ("Sân bay Đà Nẵng", ["san bay da nang", "san bay"]), ("a", []), ("Chợ Hàn", ["cho han"])])
def test_query_tokens(spark, query, tokens):
    assert one(spark, search.query_tokens(F.lit(query))) == tokens


def test_first_matches(spark):
    rows = spark.createDataFrame([(i, f"Trạm {i}") for i in range(100)], "at int, name string")
    assert [r["at"] for r in search.first_matches(rows, "tram 1", "at", ["name"]).collect()] == [1, *range(10, 20)]
    assert search.first_matches(rows, " ", "at", ["name"]).count() == 30 and search.first_matches(rows, "tram", "at", ["name"]).count() == 50
    assert {r["query_id"] for r in search.token_hits(rows, [(1, "5"), (2, "10"), (3, "99")], lambda t: F.col("name").contains(t)).collect()} == {2, 3}


@pytest.mark.parametrize("a, b, code", [("", "x", "EMPTY_ORIGIN"), ("Vị trí hiện tại", "x", "EMPTY_ORIGIN"), ("x", "", "EMPTY_DESTINATION"), ("X", "x ", "SAME_ORIGIN_DESTINATION"), ("x", "y", None)])
def test_checked_query(spark, a, b, code):
    assert one(spark, search.checked_query(F.lit(a), F.lit(b), ("vi tri hien tai",))) == code


def test_place_search(spark):
    points = spark.createDataFrame([("p1", "Cầu Rồng", "Đà Nẵng", ["dragon bridge"], 16.1, 108.2, 1), ("p2", "Chợ Hàn", "Trần Phú", [], 16.2, 108.2, 2), ("p3", "Trần Phú", "x", [], 16.20001, 108.2, 3)], "place_id string, name string, address string, keywords array<string>, lat double, lng double, ordinal int")
    stops = spark.createDataFrame([("s1", "Trần Phú 1", "y", 16.3, 108.2, 1)], "place_id string, name string, address string, lat double, lng double, ordinal int")
    asked = spark.createDataFrame([(1, "tran phu"), (2, "a"), (3, "dragon bridge da nang")], "query_id int, query string")
    found = [(r["query_id"], r["place_id"], r["score"]) for r in places.search(asked, points, stops).orderBy("query_id", "rank").collect()]
    assert found == [(1, "p3", 100), (1, "s1", 90), (3, "p1", 50)]
    named = {r["query_id"]: r["place_id"] for r in places.looked_up(asked, points, stops.withColumn("status", F.lit("verified"))).collect()}
    assert named == {1: "p2", 3: "p1"}
    asked_items = spark.createDataFrame([(1, "p1", None, None, None, None), (2, "zz", "remote", "chợ hàn", None, None), (3, "g", "remote", "x", None, None), (4, "p1", None, "mine", 1.0, 2.0), (5, "none", "remote", "none", None, None)], "item_id int, place_id string, provider string, display_name string, lat double, lng double")
    local_points = points.select("place_id", F.col("name").alias("display_name"), "lat", "lng", "ordinal")
    details = spark.createDataFrame([("g", 9.0, 9.5)], "place_id string, lat double, lng double")
    got = {r["item_id"]: (r["lat"], r["lng"]) for r in places.resolved(asked_items, details, local_points).collect()}
    assert got == {1: (16.1, 108.2), 2: (16.2, 108.2), 3: (9.0, 9.5), 4: (1.0, 2.0), 5: (None, None)}
    pin = spark.range(1).select(places.from_position(F.lit(16.05), F.lit(108.2), pin=True).alias("p"), places.from_position(F.lit(None).cast("double"), F.lit(1.0), pin=True).alias("q"), places.from_position(F.lit(16.05), F.lit(108.2)).alias("g")).first()
    assert pin["p"]["display_name"] == pin["p"]["address"] == "Ghim trên bản đồ (16.0500, 108.2000)" and pin["q"] is None and (pin["g"]["provider"], pin["g"]["display_name"]) == ("gps", "Vị trí đã chọn")
    memory = spark.createDataFrame([("a", "known")], "query string, place string")
    answered = places.remembered(spark.createDataFrame([(1, " a "), (2, "b")], "query_id int, query string"), memory, lambda rest: rest.select("query_id", F.lit("new").alias("place")))
    assert {tuple(r) for r in answered.collect()} == {(1, "known"), (2, "new")}
    late = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k int, seq int, v string")
    assert {r["v"] for r in places.newest(late, "seq", ["k"]).collect()} == {"new", "x"}
    local = spark.createDataFrame([(1, "l"), (2, "l")], "query_id int, place string")
    remote = spark.createDataFrame([(1, "r")], "query_id int, place string")
    assert {(r[0], r[1]) for r in places.federated(remote, local).collect()} == {(1, "r"), (2, "l")}
