"""Edges of the needed routes alone against a whole index, and stops of one position as heaps."""

import random

from waymark.operators import journeys, spatial


def network(spark, r):
    at = [(16 + r.randint(0, 12) / 400, 108 + r.randint(0, 12) / 400) for _ in range(60)]
    rows = [(route, i, f"s{route}_{i}", *r.choice(at)) for route in range(40) for i in range(6)] + [(99, 0, "none", None, None)]
    return rows, spark.createDataFrame(rows, "route int, idx int, name string, lat double, lng double").cache()


def test_journeys_need_edges_of_their_routes_only(spark):
    r = random.Random(5)
    _, stops = network(spark, r)
    queries = spark.createDataFrame([(q, 16 + r.random() / 33, 108 + r.random() / 33, 16 + r.random() / 33, 108 + r.random() / 33) for q in range(3)], "query_id int, o_lat double, o_lng double, d_lat double, d_lng double")
    asked = []

    def some(leaving, entering):
        asked.append((leaving or entering).count())
        assert (leaving is None) != (entering is None)
        return spatial.transfers(stops, 400.0, None, leaving, entering)

    rows = lambda df: sorted((x["query_id"], x["journey"], x["cost"], x["walk_metres"]) for x in df.collect())
    index = spatial.transfers(stops, 400.0).cache()
    expected = rows(journeys.search(queries, stops, index, 400.0))
    assert any("transfer2" in x[1] for x in expected) and rows(journeys.search(queries, stops, some, 400.0)) == expected
    assert rows(journeys.ranked(journeys.best(queries, stops, some, 400.0))) == rows(journeys.ranked(journeys.best(queries, stops, index, 400.0)))
    assert len(asked) >= 3 and max(asked) < 40
    del asked[:]
    assert rows(journeys.search(queries, stops, some, 400.0, 0)) == [x for x in expected if "transfer0" in x[1]] and not asked


def test_stops_of_one_position_are_a_heap(spark, monkeypatch):
    rows, stops = network(spark, random.Random(6))
    monkeypatch.setattr(spatial, "HEAP", 4)
    sizes, plain = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda a, b, *args, **kinds: sizes.append((a.count(), b.count())) or plain(a, b, *args, **kinds))
    found = sorted((x["from_name"], x["to_name"]) for x in spatial.transfers(stops, 400.0, 40).collect())
    index = {(x["from_name"], x["to_name"]) for x in plain(*[stops.select("route", *[stops[c].alias(f"{s}_{c}") for c in ("name", "lat", "lng")]).withColumnRenamed("route", f"{s}_route") for s in ("from", "to")], 400.0, ("from_lat", "from_lng"), ("to_lat", "to_lng")).where("from_route <> to_route").collect()}
    assert found == sorted(index) and len(found) > 1000
    assert max(sizes[0]) < 0.8 * len(rows)
