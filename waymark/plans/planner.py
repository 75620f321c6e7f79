"""The journey planner: validity codes, a search in two radii, and ranked results for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import journeys, spatial
from ..sources.stored import stored

#: Fixed values in metres: first and second search radius, walk of a transfer, and the least distance of two different places.
FIRST_RADIUS, SECOND_RADIUS, TRANSFER_WALK, SAME_PLACE = 800.0, 1500.0, 400.0, 50.0


def code(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The first problem of a pair of ends, or null."""
    missing = lat1.isNull() | lng1.isNull() | lat2.isNull() | lng2.isNull()
    distance = geo.haversine(lat1, lng1, lat2, lng2)
    return (
        F.when(missing, F.lit("INVALID_ENDPOINTS"))
        .when(~geo.valid_coordinate(lat1, lng1) | ~geo.valid_coordinate(lat2, lng2), F.lit("INVALID_COORDINATES"))
        .when(~geo.in_service_area(lat1, lng1) | ~geo.in_service_area(lat2, lng2), F.lit("OUT_OF_SERVICE_AREA"))
        .when(distance.isNull(), F.lit("COORDINATE_ERROR"))
        .when(distance < SAME_PLACE, F.lit("SAME_LOCATION"))
    )


def verified_stops(stops: DataFrame) -> DataFrame:
    """Stops with status verified and coordinates; each direction becomes a route of its own."""
    fine = stops.where((F.col("status") == "verified") & geo.valid_coordinate(F.col("lat"), F.col("lng")))
    return fine.withColumn("route", F.concat_ws("_", "route_id", "direction")).withColumn("idx", F.col("idx").cast("long"))


def usable_stops(stops: DataFrame) -> DataFrame:
    """Verified stops with coordinates, of directions that are ready and usable and have at least two stops.

    Stops: route_id, direction, idx, name, lat, lng, status, ready, usable. Each direction becomes a route of its own; ``line`` keeps the route id.
    """
    rows = verified_stops(stops).where(F.coalesce(F.col("ready"), F.lit(False)) & F.coalesce(F.col("usable"), F.lit(False)))
    enough = rows.groupBy(F.col("route").alias("r")).agg(F.count("*").alias("n")).where("n >= 2").select("r")
    return rows.join(enough, F.col("route") == F.col("r"), "left_semi").select("route", F.col("route_id").alias("line"), "idx", "name", "lat", "lng")


def direction_metrics(stops: DataFrame) -> DataFrame:
    """route, verified and total: stops of each direction, and those verified with coordinates."""
    fine = (F.col("status") == "verified") & geo.valid_coordinate(F.col("lat"), F.col("lng"))
    return stops.groupBy(F.concat_ws("_", "route_id", "direction").alias("route")).agg(F.count_if(fine).alias("verified"), F.count("*").alias("total"))


#: Stops that meet in a cell of the transfer index before it is cut into pieces.
CROWD = 20_000


def transfer_index(stops: DataFrame, crowd: int | None = CROWD) -> DataFrame:
    """Edges between usable stops of different lines within a transfer's walk; crowded cells are spread over tasks."""
    found = spatial.transfers(stops, TRANSFER_WALK, crowd)
    return found.where(F.col("from_line") != F.col("to_line"))


def plan(queries: DataFrame, stops: DataFrame, edges: DataFrame | None = None, transfers: int = 2, metrics: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked journeys, one outcome for each query) of queries (query_id, o_lat, o_lng, d_lat, d_lng) over stops as in ``usable_stops``.

    Outcome: a code of ``code``, else OK, NO_NEARBY_STOPS or NO_VIABLE_ROUTE. Queries without a journey in the first radius are searched again in the second.
    ``metrics`` (route, verified, total; a route is a direction) gives the confidence penalties; by default the stops are counted.
    """
    coded = queries.withColumn("code", code(F.col("o_lat"), F.col("o_lng"), F.col("d_lat"), F.col("d_lng")))
    good = coded.where(F.col("code").isNull()).drop("code")
    network = usable_stops(stops)
    edges = transfer_index(network) if edges is None else edges
    metrics = direction_metrics(stops) if metrics is None else metrics
    first = journeys.best(good, network, edges, FIRST_RADIUS, transfers=transfers, metrics=metrics, fits=distinct_lines)
    # a query is searched again only if nothing was found at all, so journeys that use a line twice count as found
    bare = good.join(first.select("query_id").distinct(), "query_id", "left_anti")
    open_ = stored(bare.join(journeys.search(bare, network, edges, FIRST_RADIUS, transfers, metrics).select("query_id").distinct(), "query_id", "left_anti"), "open")
    second = journeys.best(open_, network, edges, SECOND_RADIUS, transfers=transfers, metrics=metrics, fits=distinct_lines)
    ranked = journeys.ranked(first.unionByName(second))
    near = [journeys.ends(good, verified_stops(stops), p, SECOND_RADIUS).select("query_id").distinct() for p in "od"]
    both = near[0].join(near[1], "query_id").withColumn("near", F.lit(True))
    done = ranked.select("query_id").distinct().withColumn("found", F.lit(True))
    status = F.coalesce("code", F.when(F.col("found"), F.lit("OK")).when(F.col("near"), F.lit("NO_VIABLE_ROUTE")).otherwise(F.lit("NO_NEARBY_STOPS")))
    return ranked, coded.join(done, "query_id", "left").join(both, "query_id", "left").select("query_id", status.alias("outcome"))


def distinct_lines(found: DataFrame) -> DataFrame:
    """Journeys that use no line twice, in whatever direction."""
    lines = F.transform("routes", lambda r: F.regexp_replace(r.cast("string"), "_[^_]*$", ""))
    return found.where(F.size(F.array_distinct(lines)) == F.size("routes"))


def alternatives(matched: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """Text matches first, then planned journeys: for each query those of the planner alone if no route matched, else both, with ``source`` and ``order``."""
    every = matched.withColumn("source", F.lit("direct")).withColumn("order", F.lit(0)).unionByName(planned.withColumn("source", F.lit("planner")).withColumn("order", F.lit(1)), allowMissingColumns=True)
    return every.withColumn("only_planned", F.max(F.col("order") == 0).over(Window.partitionBy(*keys)) == F.lit(False))


def view_direct(matches: DataFrame, lines: DataFrame, stops: DataFrame) -> DataFrame:
    """View-models of text matches (query_id, origin, destination, route, direction, first_at, second_at), with the line's fields and the names of the stops between.

    ``lines``: route, number, fare, frequency, minutes, average_km, direction_km, brand. A frequency that is not known is null, kilometres are the average or
    the direction's.
    """
    rows = matches.join(lines, "route", "left")
    between = stops.select(F.col("route").alias("s_route"), F.col("direction").alias("s_direction"), "idx", "name")
    inside = (F.col("route") == F.col("s_route")) & (F.col("direction") == F.col("s_direction")) & (F.col("idx") >= F.col("first_at")) & (F.col("idx") <= F.col("second_at"))
    named = rows.select("query_id", "route", "direction", "first_at", "second_at").join(between, inside).groupBy("query_id", "route", "direction").agg(F.array_sort(F.collect_list(F.struct("idx", "name")))["name"].alias("names"))
    rows = rows.join(named, ["query_id", "route", "direction"], "left")
    known = F.col("frequency") != "Đang cập nhật"
    return rows.select(
        "query_id", F.lit("direct").alias("source"), "route", "direction", F.col("origin").alias("origin_name"), F.col("destination").alias("destination_name"),
        F.coalesce(F.element_at("names", 1), "origin").alias("boarding_stop"), F.coalesce(F.element_at("names", -1), "destination").alias("alighting_stop"),
        F.col("minutes").alias("duration_minutes"), F.when(F.col("minutes").isNotNull(), F.lit("Ước tính")).alias("duration_meaning"), F.coalesce("average_km", "direction_km").alias("distance_km"),
        (F.col("second_at") - F.col("first_at") + 1).cast("long").alias("stops"), F.col("fare").alias("fare_text"), F.lit("Theo lịch").alias("fare_meaning"), F.when(known, F.col("frequency")).alias("frequency_text"), "brand",
        F.when(F.size("names") > 2, F.slice("names", F.lit(2), F.size("names") - 2)).otherwise(F.array().cast("array<string>")).alias("between"), F.lit(0).alias("transfers"),
    )


def view_planned(trips: DataFrame, queries: DataFrame) -> DataFrame:
    """View-models of materialised journeys: totals over the rides, names of the ends, fare text (``--`` if there is none)."""
    totals = journeys.leg_totals(F.transform("rides", lambda r: r.withField("kilometres", r["kilometres"] if "kilometres" in dict_of_rides(trips) else F.lit(None).cast("double"))))
    rows = trips.join(queries.select("query_id", "o_label", "d_label"), "query_id")
    return rows.select(
        "query_id", F.lit("planner").alias("source"), (F.col("transfers") == 0).alias("is_direct"), F.element_at("rides", 1)["route"].alias("route"), F.col("o_label").alias("origin_name"), F.col("d_label").alias("destination_name"),
        F.col("minutes").alias("duration_minutes"), F.lit("Ước tính").alias("duration_meaning"), F.col("walk_metres"), totals["kilometres"].alias("distance_km"), totals["stops"].alias("stops"),
        F.when(F.coalesce(F.col("fare_text"), F.lit("")) == "", F.lit("--")).otherwise(F.col("fare_text")).alias("fare_text"), F.lit("Theo lịch").alias("fare_meaning"), "transfers", "rides", "walks",
    )


def dict_of_rides(trips: DataFrame) -> list[str]:
    return trips.schema["rides"].dataType.elementType.names
