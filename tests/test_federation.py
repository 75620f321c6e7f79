"""Search over several providers: order, fallback, stale requests, memory and failures."""

import pytest
from pyspark.sql import functions as F

from waymark.plans import federation

ROW = "query string, rank int, place_id string, display_name string, address string, lat double, lng double, type string"


class Remote:
    """A provider that knows some texts and counts what it is asked."""

    def __init__(self, spark, known):
        self.spark, self.known, self.asked = spark, known, []

    def __call__(self, texts):
        self.asked.append(sorted(r["query"] for r in texts.collect()))
        rows = [(q, k + 1, p, p, None, 16.0, 108.0, "remote") for q, ps in self.known.items() for k, p in enumerate(ps)]
        return self.spark.createDataFrame(rows, ROW).join(texts, "query", "left_semi")


@pytest.fixture()
def local(spark):
    points = spark.createDataFrame([("h", "Chợ Hàn", "Trần Phú", ["cho han"], 16.068, 108.224, 0), ("c", "Cầu Rồng", "", None, 16.061, 108.227, 1)], "place_id string, name string, address string, keywords array<string>, lat double, lng double, ordinal int")
    stops = spark.createDataFrame([("s", "Trạm Chợ Hàn", "Hùng Vương", 16.067, 108.223, 0)], "place_id string, name string, address string, lat double, lng double, ordinal int")
    return federation.local_provider(points, stops)


def requests(spark, *rows):
    return spark.createDataFrame(rows, "session string, sequence int, query string")


def shown(rows):
    return sorted((r["session"], r["query"], r["provider"], r["rank"], r["place_id"]) for r in rows.collect())


def test_the_first_provider_with_results_answers(spark, local):
    remote = Remote(spark, {"chợ hàn": ["r1", "r2"]})
    out, memory = federation.search(requests(spark, ("a", 1, " chợ hàn "), ("b", 1, "cầu rồng"), ("c", 1, "x"), ("d", 1, "nowhere"), ("e", 1, None)), [federation.Provider("remote", remote), local])
    assert shown(out) == [("a", "chợ hàn", "remote", 1, "r1"), ("a", "chợ hàn", "remote", 2, "r2"), ("b", "cầu rồng", "local", 1, "c")]
    assert remote.asked == [["chợ hàn", "cầu rồng", "nowhere"]]
    assert {r["query"] for r in memory.where("place_id IS NULL").collect()} == {"nowhere"}


def test_stale_requests_and_memory(spark, local):
    remote = Remote(spark, {"chợ hàn": ["r1"], "cho": ["r2"]})
    providers = [federation.Provider("remote", remote), local]
    out, memory = federation.search(requests(spark, ("a", 1, "cho"), ("a", 2, "chợ hàn"), ("b", 5, "nowhere"), ("b", 4, "cho")), providers)
    assert shown(out) == [("a", "chợ hàn", "remote", 1, "r1")] and remote.asked == [["chợ hàn", "nowhere"]]
    # another session asks the same texts: none of them, and no text without results, is asked again
    out, memory = federation.search(requests(spark, ("c", 1, "chợ hàn"), ("d", 1, "nowhere"), ("e", 1, "cho")), providers, memory)
    assert shown(out) == [("c", "chợ hàn", "remote", 1, "r1"), ("e", "cho", "remote", 1, "r2")] and remote.asked[1:] == [["cho"]]
    assert memory.select("query").distinct().count() == 3


def test_failures_and_missing_configuration_fall_through(spark, local):
    def broken(texts):
        return texts.select("query", F.raise_error(F.lit("out of order")).cast("string").alias("place_id"), *[F.lit(None).alias(c) for c in federation.RESULT if c != "place_id"])

    def refused(texts):
        raise ValueError("no key")

    never = Remote(spark, {"chợ hàn": ["r1"]})
    providers = [federation.Provider("broken", broken), federation.Provider("refused", refused), federation.Provider("off", never, configured=False), local]
    out, _ = federation.search(requests(spark, ("a", 1, "chợ hàn")), providers)
    assert [x[2:] for x in shown(out)] == [("local", 1, "h"), ("local", 2, "s")] and never.asked == []
    assert federation.search(requests(spark), providers)[0].count() == 0
    assert federation.search(requests(spark, ("a", 1, "chợ hàn")), [])[0].count() == 0


def test_details_come_from_the_item_s_provider(spark, local):
    details = lambda ids: ids.select("place_id", F.lit(16.5).alias("lat"), F.lit(108.5).alias("lng"))
    fails = lambda ids: (_ for _ in ()).throw(ValueError("down"))
    items = spark.createDataFrame([(1, "r1", "far", "R", None, None), (2, "h", "local", "Chợ Hàn", None, None), (3, "r9", "down", "Chợ Hàn", None, None), (4, "r1", "far", "own", 16.1, 108.1)], "item_id int, place_id string, provider string, display_name string, lat double, lng double")
    points = spark.createDataFrame([("h", "Chợ Hàn", 16.068, 108.224, 0)], "place_id string, display_name string, lat double, lng double, ordinal int")
    providers = [federation.Provider("far", None, details), federation.Provider("down", None, fails), local]
    found = {r["item_id"]: (r["lat"], r["lng"]) for r in federation.resolved(items, providers, points).collect()}
    assert found == {1: (16.5, 108.5), 2: (16.068, 108.224), 3: (16.068, 108.224), 4: (16.1, 108.1)}
