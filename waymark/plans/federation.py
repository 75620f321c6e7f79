"""Search over several providers of places: the newest request of each session, remembered answers, and the first provider that has results."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from . import places

LEAST_LENGTH = 2
#: What a result is: its place among the results of the query, and the place.
RESULT = ["rank", "place_id", "display_name", "address", "lat", "lng", "type"]
RESULT_TYPES = "rank int, place_id string, display_name string, address string, lat double, lng double, type string"
ANSWERS = f"query string, provider string, {RESULT_TYPES}"


@dataclass
class Provider:
    """A source of places. ``search`` takes a table of distinct texts (query) and returns the columns of RESULT with query; ``details`` takes place ids (place_id) and returns place_id, lat and lng.

    A provider that isn't configured is never asked. One whose search or details fail counts as one without results.
    """

    name: str
    search: Callable[[DataFrame], DataFrame]
    details: Callable[[DataFrame], DataFrame] | None = None
    configured: bool = True


def local_provider(points: DataFrame, stops: DataFrame, name: str = "local", limit: int = places.RESULTS) -> Provider:
    """The provider over stored places and stops (see ``places.search``; both have place_id, name, address, lat, lng and ordinal)."""

    def search(texts: DataFrame) -> DataFrame:
        hits = places.search(texts.select(F.col("query").alias("query_id"), "query"), points, stops, limit)
        known = points.select("place_id", "name", "address", F.lit("poi").alias("type")).unionByName(stops.select("place_id", "name", "address", F.lit("stop").alias("type")))
        rows = hits.join(known.dropDuplicates(["place_id"]), "place_id")
        return rows.select(F.col("query_id").alias("query"), F.col("rank").cast("int").alias("rank"), "place_id", F.col("name").alias("display_name"), "address", "lat", "lng", "type")

    def details(ids: DataFrame) -> DataFrame:
        return points.select("place_id", "lat", "lng").unionByName(stops.select("place_id", "lat", "lng")).dropDuplicates(["place_id"]).join(ids, "place_id", "left_semi")

    return Provider(name, search, details)


def attempted(name: str, work: Callable[[], DataFrame]) -> DataFrame | None:
    """The stored result of a provider's work, or None if it fails."""
    try:
        return stored(work(), f"answers-{name}")
    except (PySparkException, ValueError, OSError) as e:
        logging.getLogger(__name__).warning("provider %s failed: %s", name, str(e).splitlines()[0])
        return None


def answered(texts: DataFrame, providers: Sequence[Provider]) -> DataFrame:
    """Answers (query, provider and RESULT) to distinct texts: those of the first configured provider that has any; texts without results anywhere have one row without provider."""
    spark, rest = texts.sparkSession, texts.select("query").distinct()
    found = spark.createDataFrame([], ANSWERS)
    for p in providers:
        if not p.configured:
            continue
        rows = attempted(p.name, lambda p=p, rest=rest: p.search(rest).where(F.col("place_id").isNotNull()).select("query", *RESULT))
        if rows is not None:
            found = found.unionByName(rows.join(rest, "query", "left_semi").select("query", F.lit(p.name).alias("provider"), *[F.col(c).cast(t.split(" ")[1]).alias(c) for c, t in zip(RESULT, RESULT_TYPES.split(", "), strict=True)]))
            rest = rest.join(rows, "query", "left_anti")
    nothing = [F.lit(None).cast(t.split(" ")[1]).alias(t.split(" ")[0]) for t in f"provider string, {RESULT_TYPES}".split(", ")]
    return found.unionByName(rest.select("query", *nothing))


def search(requests: DataFrame, providers: Sequence[Provider], memory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, memory) of requests (session, sequence, query).

    Only the request with the greatest sequence number of each session is answered, as older ones are stale; texts are trimmed, and those under two characters have no results. Texts that ``memory`` knows
    are not asked again, in whatever session, also if they had no results. Results: session, sequence, query, provider and RESULT. The memory returned (query, provider and RESULT) holds the old one and
    the new answers, and is stored.
    """
    spark = requests.sparkSession
    memory = spark.createDataFrame([], ANSWERS) if memory is None else memory
    current = places.newest(requests.withColumn("query", F.trim("query")), "sequence", ["session"]).where(F.length("query") >= LEAST_LENGTH)
    current = stored(current.select("session", "sequence", "query").distinct(), "requests")
    texts = current.select("query").distinct().join(memory, "query", "left_anti")
    after = stored(memory.unionByName(answered(texts, providers)), "memory")
    return current.join(after.where(F.col("place_id").isNotNull()), "query").select("session", "sequence", "query", "provider", *RESULT), after


def resolved(items: DataFrame, providers: Sequence[Provider], local: DataFrame) -> DataFrame:
    """Places of chosen results (item_id, place_id, provider, display_name, lat, lng): each provider's details of its own items, with the local fallback of ``places.resolved``."""
    by_name = [p for p in providers if p.configured and p.details]
    remote = items.sparkSession.createDataFrame([], "place_id string, lat double, lng double")
    for p in by_name:
        ids = items.where(F.col("provider") == p.name).select("place_id").distinct()
        rows = attempted(p.name, lambda p=p, ids=ids: p.details(ids).select("place_id", "lat", "lng"))
        if rows is not None:
            remote = remote.unionByName(rows)
    named = items.withColumn("provider", F.when(F.col("provider").isin([p.name for p in by_name]) & (F.col("provider") != "local"), F.lit("remote")).otherwise(F.col("provider")))
    return places.resolved(named, remote, local)
