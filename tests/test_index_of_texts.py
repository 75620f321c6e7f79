"""The inverted index shuffles rows, not their pairs of key and token."""

from pyspark.sql import functions as F

from waymark.operators import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_shuffled(spark):
    rows = spark.range(100).select("id", F.array(F.lit("a"), F.col("id").cast("string")).alias("x"))
    assert plan_of(catalog.inverted_index(rows, "id", F.col("x"))).count("Exchange ") == 1
    assert plan_of(catalog.token_counts(rows, "id", F.col("x"))).count("Exchange ") == 2  # rows, then partial counts


def test_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a", "c"]), (2, ["a"]), (None, ["a"]), (None, ["a", "b"]), (3, None), (4, [])], "k long, x array<string>")
    found = catalog.inverted_index(rows, "k", F.col("x"), 4).collect()
    whole = {t: (sorted(k for r in found if r["token"] == t for k in r["keys"]), sum(r["n"] for r in found if r["token"] == t)) for t in "abc"}
    assert whole == {"a": ([1, 2], 3), "b": ([1], 2), "c": ([1], 1)}
    assert {r["token"]: (r["n"], r["first_key"], r["last_key"]) for r in catalog.token_counts(rows, "k", F.col("x")).collect()} == {"a": (3, 1, 2), "b": (2, 1, 1), "c": (1, 1, 1)}
