"""Journeys by layers against all journeys, ranked."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import journeys, spatial


@pytest.mark.parametrize("seed, doubled", [(1, False), (2, True)])
def test_layers_give_the_same_journeys(spark, seed, doubled):
    r = random.Random(seed)
    # a grid of lines in both directions, a little over a kilometre apart
    stops = []
    for route in range(16):
        line, way = divmod(route, 4)
        for i in range(10):
            along = (i if way % 2 == 0 else 9 - i) / 300 + r.uniform(-0.0004, 0.0004)
            y, x = (line / 100, along) if way < 2 else (along, line / 100)
            stops.append((route, i, f"s{route}_{i}", 16.0 + y, 108.0 + x))
    network = spark.createDataFrame(stops, "route int, idx int, name string, lat double, lng double")
    edges = spatial.transfers(network, 400.0)
    if doubled:  # edges that come twice, the second time longer
        edges = edges.unionByName(edges.where("from_idx % 2 = 0").withColumn("metres", F.col("metres") + 100))
    edges = edges.cache()
    queries = spark.createDataFrame([(q, 16.0 + r.random() / 33, 108.0 + r.random() / 33, 16.0 + r.random() / 33, 108.0 + r.random() / 33) for q in range(16)], "query_id int, o_lat double, o_lng double, d_lat double, d_lng double")
    metrics = spark.createDataFrame([(route, r.randint(0, 9), 9) for route in range(16)], "route int, verified int, total int")
    rows = lambda df: sorted((x["query_id"], x["rank"], x["journey"], x["badge"], x["cost"], x["walk_metres"]) for x in journeys.ranked(df).collect())
    every = journeys.search(queries, network, edges, 900.0, metrics=metrics).cache()
    by_layers = journeys.best(queries, network, edges, 900.0, metrics=metrics)
    expected = rows(every)
    assert len(expected) > 40 and any(x[1] == 5 and 'transfer2' in x[2] for x in expected) and {"direct", "least_walking"} <= {x[3] for x in expected}
    assert rows(by_layers) == expected
    assert by_layers.count() < every.count()
    few = lambda df: df.where(F.array_position("routes", 3) == 0)
    assert rows(journeys.best(queries, network, edges, 900.0, metrics=metrics, fits=few)) == rows(few(every))


def test_nothing_is_searched_without_queries(spark):
    network = spark.createDataFrame([(1, 0, "a", 16.0, 108.0)], "route int, idx int, name string, lat double, lng double")
    none = spark.createDataFrame([], "query_id int, o_lat double, o_lng double, d_lat double, d_lng double")
    assert journeys.ranked(journeys.best(none, network, spatial.transfers(network), 400.0)).count() == 0
