"""Routes that lead from one text to another: text matches of stops, service gates, and the first ordered pair of each direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import search, sequences


def routes_between(queries: DataFrame, stops: DataFrame, usable: DataFrame) -> DataFrame:
    """query_id, route, direction, first_at, second_at and stops (how many from one to the other, both included) of every match.

    ``queries``: query_id, origin, destination; empty and equal texts match nothing. ``stops``: route, direction (outbound or inbound), idx, name, street, display_name, and the labels of
    the route's terminals, start_label and end_label, as of the outbound direction. ``usable`` (route, direction) lists the directions in service; those with fewer than two
    stops do not count. Tokens of the queries find their stops through an index of parts, so any number of queries is one set of equi-joins.
    """
    o, d = fold(F.col("origin")), fold(F.col("destination"))
    asked = queries.where((o != "") & (d != "") & (o != d))
    sides = [asked.select("query_id", F.lit(side == "origin").alias("is_origin"), F.explode(search.query_tokens(F.col(side))).alias("token")) for side in ("origin", "destination")]
    keys = ["route", "direction"]
    rows = sequences.with_ends(stops.join(usable.select(*keys).distinct(), keys, "left_semi"), keys, "idx")
    outbound = F.col("direction") == "outbound"
    start = F.when(outbound, F.col("start_label")).otherwise(F.col("end_label"))
    end = F.when(outbound, F.col("end_label")).otherwise(F.col("start_label"))
    named = rows.select(*keys, "idx", "name", "street", F.col("display_name").alias("display"), "is_first", "is_last", start.alias("start"), end.alias("end"))
    hits = search.matched_stops(sides[0].unionByName(sides[1]), named, [*keys, "idx"])
    marked = hits.groupBy("query_id", *keys, "idx").agg(F.bool_or("is_origin").alias("is_origin"), F.bool_or(~F.col("is_origin")).alias("is_destination"))
    found = sequences.first_ordered_pair(marked, ["query_id", *keys], "idx", F.col("is_origin"), F.col("is_destination"))
    return found.withColumn("stops", F.col("second_at") - F.col("first_at") + 1)
