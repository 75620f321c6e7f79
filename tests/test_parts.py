"""The index of parts against loops, and plans without nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from waymark import catalog_queries, validation_queries  # noqa: F401
from waymark.operators.parts import PartIndex, grams, own_grams
from waymark.plans import places

SF = "/root/testdata/sf0.001"


def words(r, n, most):
    return ["".join(r.choice("ab é") for _ in range(r.randint(0, most))) for _ in range(n)]


def test_grams(spark):
    row = spark.createDataFrame([("abcab", "a", "")], "x string, y string, z string").select(grams(F.col("x"), 2).alias("two"), grams(F.col("y"), 2).alias("none"), own_grams(F.col("x")).alias("x"), own_grams(F.col("y")).alias("y"), own_grams(F.col("z")).alias("z")).first()
    assert (sorted(row["two"]), row["none"], sorted(row["x"]), row["y"], row["z"]) == (["ab", "bc", "ca"], [], ["abc", "bca", "cab"], ["a"], [""])


@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_equal_loops(spark, seed):
    r = random.Random(seed)
    texts, tokens = words(r, 120, 9) + ["", "𝒳yz", None], words(r, 120, 6) + ["", "a", "yz", "𝒳y", None]
    index = PartIndex.build(spark.createDataFrame([(t,) for t in texts + texts], "t string"), "t")
    asked = spark.createDataFrame([(t,) for t in tokens + tokens], "q string")
    pairs = lambda df: sorted((x["token"], x["text"]) for x in df.collect())
    some = lambda xs: {x for x in xs if x is not None}
    assert pairs(index.holding(asked, "q")) == sorted((q, t) for q in some(tokens) for t in some(texts) if len(q) >= 2 and q in t)
    assert pairs(index.held(asked, "q")) == sorted((q, t) for q in some(tokens) for t in some(texts) if t in q)
    assert index.keys.count() == index.texts.count() == len(some(texts))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "t string")
    some = spark.createDataFrame([("abc",)], "t string")
    assert PartIndex.build(none, "t").holding(some, "t").count() == PartIndex.build(some, "t").held(none, "t").count() == 0


def test_places_equal_a_loop(spark):
    r = random.Random(3)
    rows = [(f"p{i}", r.choice(words(r, 5, 8)), r.choice(words(r, 5, 8)), words(r, r.randint(0, 2), 4), 16 + i / 100, 108.0, i) for i in range(60)]
    points = spark.createDataFrame(rows, "place_id string, name string, address string, keywords array<string>, lat double, lng double, ordinal int")
    stops = points.limit(0).drop("keywords").withColumn("status", F.lit("verified"))
    asked = [(i, q) for i, q in enumerate(words(r, 40, 5))]
    table = spark.createDataFrame(asked, "query_id int, query string")
    fold = lambda x: " ".join(x.replace("é", "e").split(" ")).strip()
    hits = {}
    for i, q in asked:
        q = fold(q)
        for p in rows if len(q) >= 2 else []:
            name, address, keys = fold(p[1]), fold(p[2]), [fold(k) for k in p[3]]
            if q in name or q in address or any(q in k or k in q for k in keys):
                hits.setdefault(i, []).append((-(100 if name.startswith(q) else 80 if q in name else 50), p[6], p[0]))
    found = {}
    for x in places.search(table, points, stops, limit=100).collect():
        found.setdefault(x["query_id"], []).append((-x["score"], x["ordinal"], x["place_id"]))
    assert {i: sorted(h) for i, h in found.items()} == {i: sorted(h) for i, h in hits.items()}


@pytest.mark.parametrize("name", ["q_stop_match", "q_routes_between", "q_place_search"])
def test_texts_meet_by_equi_joins_only(spark, name):
    plan = catalog_queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
