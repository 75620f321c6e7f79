"""Points and places of one position are looked up once; pairs of same stops are not gathered."""

from waymark.operators import search, spatial


def test_points_of_one_position_are_one_lookup(spark, monkeypatch):
    points = spark.createDataFrame([(i, 16.0 + i % 3 / 100, 108.0) for i in range(90)] + [(99, None, 108.0)], "point int, y double, x double")
    shops = spark.createDataFrame([(i, 16.0 + i % 2 / 100, 108.001) for i in range(60)], "place int, lat double, lng double")
    sizes, plain = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda a, b, *args, **kinds: sizes.append((a.count(), b.count())) or plain(a, b, *args, **kinds))
    found = sorted((x["point"], x["rank"], x["place"]) for x in spatial.nearest(points, shops, "point", "place", 500.0, 2, ("y", "x"), ("lat", "lng")).collect())
    assert found == sorted((i, k + 1, i % 3 + 2 * k) for i in range(90) if i % 3 < 2 for k in range(2))
    assert sizes == [(3, 4)]


def test_same_stops_come_once_without_an_aggregate(spark):
    kinds = "{} int, name string, lat double, lng double"
    stops = spark.createDataFrame([(1, "a", 16.0, 108.0, "verified"), (2, "", 16.0, 108.0, "verified"), (3, "c", None, None, "verified"), (4, "a", 16.0, 108.0, None)], kinds.format("stop_id") + ", status string")
    places = spark.createDataFrame([(7, "a", 16.00005, 108.0), (8, None, 16.0, 108.0), (9, "c", 17.0, 108.0)], kinds.format("place_id"))
    found = search.same_stops(stops, places)
    expected = [(1, 7), (1, 8), (2, 7), (2, 8), (3, 9)]
    assert sorted(map(tuple, found.collect())) == expected
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, search.same_stops(stops.unionByName(stops), places).collect())) == expected
