"""Distance joins where most places stand in one cell."""

import random

from pyspark.sql import functions as F

from waymark.operators import spatial


def places(r, crowded, spread):
    at = [(16.05 + r.uniform(0, 0.0005), 108.2 + r.uniform(0, 0.0005)) for _ in range(crowded)] + [(16 + r.random() / 5, 108 + r.random() / 5) for _ in range(spread)]
    return [(i, i % 7, *p) for i, p in enumerate(at)]


def test_a_crowded_cell_is_cut_into_pieces(spark):
    rows = spark.createDataFrame(places(random.Random(1), 900, 300), "stop int, route int, lat double, lng double").cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plain, cut = spatial.transfers(rows, 60.0), spatial.transfers(rows, 60.0, crowd=50)
    key = ["from_stop", "to_stop", "metres"]
    expected = sorted(tuple(r) for r in plain.select(*key).collect())
    assert len(expected) > 50_000 and sorted(tuple(r) for r in cut.select(*key).collect()) == expected
    assert cut.columns == plain.columns
    # no key of the join stands for more than a few hundred of the right rows
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "piece" in cut._jdf.queryExecution().optimizedPlan().toString() and "piece" not in spatial.transfers(rows, 60.0, crowd=100_000)._jdf.queryExecution().optimizedPlan().toString()
        sizes = cut.groupBy(F.spark_partition_id().alias("p")).count().collect()
        whole = plain.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in sizes) < 0.6 * len(expected) < max(r["count"] for r in whole)


def test_nearest_in_a_crowd(spark):
    r = random.Random(2)
    shops = spark.createDataFrame(places(r, 600, 200), "place int, route int, lat double, lng double").cache()
    points = spark.createDataFrame([(i, 16.05 + r.uniform(0, 0.0005), 108.2 + r.uniform(0, 0.0005)) for i in range(40)] + [(100 + i, 16 + r.random() / 5, 108 + r.random() / 5) for i in range(60)] + [(999, None, 1.0)], "point int, y double, x double").cache()
    find = lambda crowd: sorted((x["point"], x["rank"], x["place"], x["metres"]) for x in spatial.nearest(points, shops, "point", "place", 2000.0, 5, ("y", "x"), ("lat", "lng"), crowd).collect())
    expected = find(None)
    assert find(20) == expected == find(10_000) and len({p for p, *_ in expected}) > 50
