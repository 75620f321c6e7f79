"""Journeys with up to two transfers between query points, as joins over (query, route) pairs.

Stops: route, idx, name, lat, lng (usable stops of ready directions only; a direction is a route of its own). Boards and alights are the stops near a query's ends, one for each
route: the one with the lowest index. Edges come from ``spatial.transfers`` with from_idx and to_idx, all of them or those that touch the routes of boards and alights.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.stored import stored
from .spatial import between_vertices, nearest_vertex, within

#: Minutes for a stop, least ride minutes without and with transfers, waiting minutes and cost of a transfer, detour limit, results.
STOP_MINUTES, LEAST_DIRECT, LEAST_LEG, BUFFER, TRANSFER_COST, MAX_DETOUR, RESULTS = 2, 5, 4, 5, 12, 1.8, 5


def ends(queries: DataFrame, stops: DataFrame, prefix: str, metres: float, limit: int = 15) -> DataFrame:
    """The usable stops of each route near an end of the query: query_id, route, idx, name, walk, lat, lng; the ``limit`` nearest stops count."""
    at = (f"{prefix}_lat", f"{prefix}_lng")
    near = within(queries.select("query_id", *at), stops, metres, at, ("lat", "lng"), spread="left")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("metres", "route", "idx"))).where(F.col("rank") <= limit)
    first = Window.partitionBy("query_id", "route").orderBy("idx")
    return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") == 1).select("query_id", "route", "idx", "name", F.col("metres").alias("walk"), "lat", "lng")


def renamed(df: DataFrame, prefix: str, kept: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in kept else f"{prefix}_{c}") for c in df.columns])


def ride(prefix_a: str, prefix_b: str) -> Column:
    return F.coalesce(geo.haversine(F.col(f"{prefix_a}_lat"), F.col(f"{prefix_a}_lng"), F.col(f"{prefix_b}_lat"), F.col(f"{prefix_b}_lng")), F.lit(0.0))


def direct(boards: DataFrame, alights: DataFrame) -> DataFrame:
    """Journeys on one route. Boards may have a column penalty (see ``with_penalty``)."""
    b, a = renamed(with_penalty(boards), "b"), renamed(alights, "a")
    rows = b.join(a, "query_id").where((F.col("b_route") == F.col("a_route")) & (F.col("b_idx") < F.col("a_idx")))
    minutes = F.greatest((F.col("a_idx") - F.col("b_idx")) * STOP_MINUTES, F.lit(LEAST_DIRECT))
    walks = geo.walking_minutes(F.col("b_walk")) + geo.walking_minutes(F.col("a_walk"))
    return rows.select("query_id", F.lit(0).alias("transfers"), F.array("b_route").alias("routes"), F.array("b_idx", "a_idx").alias("places"), walks.cast("int").alias("walk_minutes"), minutes.cast("int").alias("ride_minutes"), F.round(F.col("b_walk") + F.col("a_walk"), 1).alias("walk_metres"), F.col("b_penalty").alias("penalty"))


def with_penalty(rows: DataFrame, name: str = "penalty") -> DataFrame:
    """The rows with a penalty of 0 where they have none."""
    return rows if name in rows.columns else rows.withColumn(name, F.lit(0.0))


def leg_minutes(first: Column, last: Column) -> Column:
    return F.greatest((last - first) * STOP_MINUTES, F.lit(LEAST_LEG))


def ahead(queries: DataFrame, boards: DataFrame, edges: DataFrame) -> DataFrame:
    """First ride and transfer of each query: where it stands then, and what is behind it. Only what may still reach the destination within the detour limit stays."""
    straight = geo.haversine(F.col("o_lat"), F.col("o_lng"), F.col("d_lat"), F.col("d_lng"))
    rows = renamed(with_penalty(boards), "b").join(queries.select("query_id", "d_lat", "d_lng", straight.alias("straight")), "query_id")
    e = with_penalty(edges, "to_penalty")
    rows = rows.join(e, (F.col("b_route") == F.col("from_route")) & (F.col("from_idx") > F.col("b_idx")))
    path = F.col("b_walk") + ride("b", "from") + F.col("metres")
    # the rest of the way is no shorter than the straight line to the destination, but for roundings of 0.1 metres
    rest = F.coalesce(geo.exact_haversine(F.col("to_lat"), F.col("to_lng"), F.col("d_lat"), F.col("d_lng")), F.lit(0.0))
    rows = rows.withColumn("path", path).where(F.col("path") + rest <= MAX_DETOUR * F.col("straight") + 10)
    return rows.select(
        "query_id", "straight", "path", F.col("b_route").alias("r1"), F.col("b_idx").alias("i0"), F.col("from_idx").alias("i1"), F.col("to_route").alias("r2"), F.col("to_idx").alias("i2"), F.col("to_lat").alias("at_lat"), F.col("to_lng").alias("at_lng"),
        leg_minutes(F.col("b_idx"), F.col("from_idx")).alias("rides"), (geo.walking_minutes(F.col("b_walk")) + geo.walking_minutes(F.col("metres"))).alias("walks"), (F.col("b_walk") + F.col("metres")).alias("walked"), (F.col("b_penalty") + F.col("to_penalty")).alias("penalty"),
    )


def back(queries: DataFrame, alights: DataFrame, edges: DataFrame) -> DataFrame:
    """Last transfer and ride of each query, seen from its destination: routes that lead to one it can alight from. Only what the origin may reach within the detour limit stays."""
    rows = renamed(alights, "a").join(with_penalty(edges, "to_penalty"), (F.col("a_route") == F.col("to_route")) & (F.col("to_idx") < F.col("a_idx")))
    straight = geo.haversine(F.col("o_lat"), F.col("o_lng"), F.col("d_lat"), F.col("d_lng"))
    rows = rows.join(queries.select("query_id", "o_lat", "o_lng", straight.alias("o_straight")), "query_id")
    # as in ``ahead``: the way there is no shorter than the straight line from the origin
    so_far = F.coalesce(geo.exact_haversine(F.col("o_lat"), F.col("o_lng"), F.col("from_lat"), F.col("from_lng")), F.lit(0.0))
    rows = rows.where(so_far + F.col("metres") + ride("to", "a") + F.col("a_walk") <= MAX_DETOUR * F.col("o_straight") + 10)
    return rows.select(
        "query_id", F.col("from_route").alias("r2"), F.col("from_idx").alias("i3"), F.col("from_lat"), F.col("from_lng"), F.col("to_route").alias("r3"), F.col("to_idx").alias("i4"), F.col("a_idx").alias("i5"),
        (F.col("metres") + ride("to", "a") + F.col("a_walk")).alias("path_3"), leg_minutes(F.col("to_idx"), F.col("a_idx")).alias("ride_3"), (geo.walking_minutes(F.col("metres")) + geo.walking_minutes(F.col("a_walk"))).alias("walks_3"), (F.col("metres") + F.col("a_walk")).alias("walked_3"), F.col("to_penalty").alias("penalty_3"),
    )


def finished(rows: DataFrame, transfers: int, routes: list[str], places: list[str], walks: Column, rides: Column, walked: Column, penalty: Column) -> DataFrame:
    return rows.select("query_id", F.lit(transfers).alias("transfers"), F.array(*routes).alias("routes"), F.array(*places).alias("places"), walks.cast("int").alias("walk_minutes"), rides.cast("int").alias("ride_minutes"), F.round(walked, 1).alias("walk_metres"), penalty.alias("penalty"))


def transferring(queries: DataFrame, boards: DataFrame, alights: DataFrame, edges: DataFrame | None, transfers: int, first: DataFrame | None = None) -> DataFrame:
    """Journeys with one or two transfers on pairwise different routes whose path estimate is at most MAX_DETOUR times the straight line.

    Two transfers meet on the route in the middle: what the first transfer reaches (``first``, from ``ahead``) and what the last one needs.
    """
    first = ahead(queries, boards, edges) if first is None else first
    if transfers == 1:
        last = first.join(renamed(alights, "a"), "query_id").where((F.col("r2") == F.col("a_route")) & (F.col("a_idx") > F.col("i2")) & (F.col("r1") != F.col("r2")))
        last = last.where(F.col("path") + ride("at", "a") + F.col("a_walk") <= MAX_DETOUR * F.col("straight"))
        return finished(last, 1, ["r1", "r2"], ["i0", "i1", "i2", "a_idx"], F.col("walks") + geo.walking_minutes(F.col("a_walk")), F.col("rides") + leg_minutes(F.col("i2"), F.col("a_idx")), F.col("walked") + F.col("a_walk"), F.col("penalty"))
    # few rows meet many, so that the work follows the result and is dealt out by number, not by size
    parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = first.repartition(parts, "query_id", "r2").join(back(queries, alights, edges), ["query_id", "r2"]).where((F.col("i3") > F.col("i2")) & (F.col("r1") != F.col("r2")) & (F.col("r3") != F.col("r1")) & (F.col("r3") != F.col("r2")))
    both = both.where(F.col("path") + ride("at", "from") + F.col("path_3") <= MAX_DETOUR * F.col("straight"))
    return finished(both, 2, ["r1", "r2", "r3"], ["i0", "i1", "i2", "i3", "i4", "i5"], F.col("walks") + F.col("walks_3"), F.col("rides") + leg_minutes(F.col("i2"), F.col("i3")) + F.col("ride_3"), F.col("walked") + F.col("walked_3"), F.col("penalty") + F.col("penalty_3"))


def costed(journeys: DataFrame) -> DataFrame:
    """Add minutes, cost and id; the cost holds the confidence penalties of the routes."""
    minutes = F.col("walk_minutes") + F.col("ride_minutes") + BUFFER * F.col("transfers")
    cost = 1.5 * F.col("walk_minutes") + F.col("ride_minutes") + (TRANSFER_COST + BUFFER) * F.col("transfers") + F.col("penalty")
    name = F.concat_ws("_", F.concat(F.lit("transfer"), F.col("transfers").cast("string")), F.concat_ws("_", F.col("routes").cast("array<string>")), F.concat_ws("_", F.col("places").cast("array<string>")))
    return with_penalty(journeys).withColumn("minutes", minutes).withColumn("cost", cost).withColumn("journey", name)


def ranked(journeys: DataFrame, limit: int = RESULTS) -> DataFrame:
    """The best ``limit`` journeys of each query with rank and badge; a signature (routes and places) counts once.

    Costs are multiples of 0.5, so that a tolerance of 0.001 means equal costs to three decimals; ids compare as in Unicode collation, not by code.
    """
    rows = journeys.withColumn("order_cost", F.round("cost", 3)).withColumn("order_id", F.collate("journey", "UNICODE"))
    order = ["transfers", "order_cost", "walk_metres", "minutes", "order_id"]
    once = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "journey").orderBy(*order))).where(F.col("rank") == 1)
    top = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).drop("order_cost", "order_id")
    least = lambda c: F.min_by("rank", F.struct(c, "rank")).over(Window.partitionBy("query_id"))
    badge = F.when(F.col("transfers") == 0, F.lit("direct")).when(F.col("rank") == least("walk_metres"), F.lit("least_walking")).when(F.col("rank") == least("minutes"), F.lit("fastest")).otherwise(F.concat(F.lit("option_"), F.col("rank").cast("string")))
    return top.withColumn("badge", badge)


def penalised(rows: DataFrame, route: str, name: str, metrics: DataFrame | None) -> DataFrame:
    """Add the confidence penalty of a route from its counts of stops (route, verified, total); routes without counts have none."""
    if metrics is None:
        return rows
    m = metrics.select(F.col("route").alias("m_route"), geo.confidence_penalty(F.col("verified"), F.col("total")).alias("m_penalty"))
    return rows.join(m, F.col(route) == F.col("m_route"), "left").withColumn(name, F.coalesce("m_penalty", F.lit(0.0))).drop("m_route", "m_penalty")


def both_ends(queries: DataFrame, stops: DataFrame, metres: float, metrics: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Boards with the penalty of their route, and alights; stored, as every layer reads these few rows for each query."""
    boards = penalised(ends(queries, stops, "o", metres), "route", "penalty", metrics)
    return stored(with_penalty(boards), "boards"), stored(ends(queries, stops, "d", metres), "alights")


#: A transfer index, or what finds the edges from some routes (route) or to some; the other one is None.
Edges = DataFrame | Callable[[DataFrame | None, DataFrame | None], DataFrame]


def touching(edges: Edges, leaving: DataFrame | None = None, entering: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Edges from the routes of boards, or to those of alights, with their penalties. What an index doesn't hold is found for these routes alone, and stored."""
    if not isinstance(edges, DataFrame):
        edges = stored(edges(*[None if ends is None else stored(ends.select("route").distinct(), "routes") for ends in (leaving, entering)]), "edges")
    return penalised(edges, "to_route", "to_penalty", metrics)


def search(queries: DataFrame, stops: DataFrame, edges: Edges, metres: float, transfers: int = 2, metrics: DataFrame | None = None) -> DataFrame:
    """All journeys of each query with up to ``transfers`` transfers, boarding and alighting within ``metres`` of its ends.

    ``edges`` is a stored transfer index (see ``sources.stored``), which is read for the first and for the last transfer, or a function that finds the edges of the routes near the ends: best where queries are few.
    """
    boards, alights = both_ends(queries, stops, metres, metrics)
    every = [direct(boards, alights)]
    first = stored(ahead(queries, boards, touching(edges, leaving=boards, metrics=metrics)), "ahead") if transfers else None
    every += [transferring(queries, boards, alights, touching(edges, entering=alights, metrics=metrics) if k == 2 else None, k, first) for k in range(1, transfers + 1)]
    return costed(reduce(DataFrame.unionByName, every))


#: What identifies an edge.
EDGE = ["from_route", "from_idx", "to_route", "to_idx"]


def leading(journeys: DataFrame, limit: int, once: bool) -> DataFrame:
    """The journeys among which are the first ``limit`` of each query in the order of ``ranked``, with all that tie with the last of them. ``once``: no signature comes twice.

    The order needs no ids but for ties, so names are made for what is left; ranks are limited before rows are shuffled.
    """
    rows = journeys.withColumn("order_minutes", F.col("walk_minutes") + F.col("ride_minutes") + BUFFER * F.col("transfers")).withColumn("order_cost", F.round(1.5 * F.col("walk_minutes") + F.col("ride_minutes") + F.col("penalty"), 3))
    measures = ["order_cost", "walk_metres", "order_minutes"]
    if not once:
        best = Window.partitionBy("query_id", "routes", "places").orderBy(*measures)
        rows = rows.withColumn("order_rank", F.row_number().over(best)).where(F.col("order_rank") == 1).drop("order_rank")
    rows = rows.withColumn("order_rank", F.rank().over(Window.partitionBy("query_id").orderBy(*measures))).where(F.col("order_rank") <= limit)
    return rows.drop("order_rank", "order_cost", "order_minutes")


def best(queries: DataFrame, stops: DataFrame, edges: Edges, metres: float, limit: int = RESULTS, transfers: int = 2, metrics: DataFrame | None = None, fits: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Journeys of each query of which ``ranked`` takes the same ``limit`` as of all that ``search`` finds.

    Fewer transfers come first, so there is a layer for each number of them: a query that has ``limit`` journeys after a layer is out of the next ones, and each layer keeps its leading journeys only. Layers are
    stored; nothing is searched once no query is open. ``fits`` drops journeys that don't count.
    """
    boards, alights = both_ends(queries, stops, metres, metrics)
    once = lambda edges: edges.groupBy(*EDGE).count().where("count > 1").isEmpty()
    single = True
    fits = fits or (lambda rows: rows)
    layers, open_, first = [], queries, None
    for k in range(transfers + 1):
        if k == 0:
            rows = direct(boards, alights)
        else:
            mine = lambda rows: rows.join(open_.select("query_id"), "query_id", "left_semi")  # noqa: E731, B023
            met = touching(edges, leaving=mine(boards), metrics=metrics) if k == 1 else touching(edges, entering=mine(alights), metrics=metrics)
            single = single and once(met)
            first = mine(first) if first is not None else stored(ahead(open_, mine(boards), met), "ahead")
            rows = transferring(open_, mine(boards), mine(alights), met, k, first)
        layers.append(stored(leading(fits(rows), limit, single), "layer"))
        if k < transfers:
            found = reduce(DataFrame.unionByName, layers).groupBy("query_id").agg(F.count_distinct("routes", "places").alias("n"))
            open_ = stored(open_.join(found.where(F.col("n") >= limit), "query_id", "left_anti"), "open")
            if open_.isEmpty():
                break
    return costed(reduce(DataFrame.unionByName, layers))


def with_legs(found: DataFrame) -> DataFrame:
    """Add legs: array of struct<kind, role, route, board, alight>, a walk at either end and between rides (3, 5 or 7 legs)."""
    kind = "string" if dict(found.dtypes)["routes"] == "array<string>" else "bigint"

    def leg(what: str, role: str, route: Column, board: Column, alight: Column) -> Column:
        return F.struct(F.lit(what).alias("kind"), F.lit(role).alias("role"), route.cast(kind).alias("route"), board.cast("long").alias("board"), alight.cast("long").alias("alight"))

    none = F.lit(None)
    rides = F.transform("routes", lambda r, k: F.array(leg("ride", "ride", r, F.get("places", 2 * k), F.get("places", 2 * k + 1)), leg("walk", "transfer", none, none, none)))
    middle = F.flatten(rides)
    legs = F.concat(F.array(leg("walk", "origin", none, none, none)), F.slice(middle, F.lit(1), F.size(middle) - 1), F.array(leg("walk", "destination", none, none, none)))
    return found.withColumn("legs", legs)


def fare_summary(fares: Column) -> Column:
    """The fare texts of a journey's rides, joined."""
    return F.array_join(F.array_compact(fares), " + ")


def walking_leg(role: Column, from_label: Column, to_label: Column, from_at: tuple[Column, Column], to_at: tuple[Column, Column]) -> Column:
    """struct of an estimated walk: role, labels, whole metres, minutes and its text; null if a coordinate is invalid."""
    metres = geo.half_up(geo.haversine(*from_at, *to_at)).cast("long")
    minutes = geo.walking_minutes(metres).cast("long")
    words = F.concat(F.lit("Đi bộ ước tính ~"), metres.cast("string"), F.lit("m ("), minutes.cast("string"), F.lit(" phút)"))
    return F.when(metres.isNotNull(), F.struct(role.alias("role"), from_label.alias("from_label"), to_label.alias("to_label"), metres.alias("metres"), minutes.alias("minutes"), words.alias("summary")))


def confidence_score(verified: Column, total: Column) -> Column:
    """The share of verified stops to two decimals; 1 without figures."""
    return F.coalesce(geo.half_up(F.try_divide(F.coalesce(verified, F.lit(0)).cast("double"), F.nullif(total, F.lit(0)).cast("double")), 100.0), F.lit(1.0))


def rides_of(found: DataFrame, stops: DataFrame, lines: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """One row for each ride of each journey (query_id, journey, leg): its route's number, name and fare, both stops, stops between, minutes, and the part of the line's shape.

    ``stops``: route, idx, name, lat, lng; ``lines``: route, number, name, fare; ``shapes``: route, points (array of struct lat, lng). A shape whose vertices
    nearest to the stops run backwards gives null.
    """
    least = F.when(F.col("transfers") == 0, F.lit(LEAST_DIRECT)).otherwise(F.lit(LEAST_LEG))
    rows = found.select("query_id", "journey", least.alias("least"), F.posexplode("routes").alias("leg", "route"), "places")
    rows = rows.select("query_id", "journey", "leg", "route", "least", F.get("places", F.col("leg") * 2).alias("board"), F.get("places", F.col("leg") * 2 + 1).alias("alight"))
    for end in ("board", "alight"):
        s = stops.select(F.col("route").alias("s_route"), F.col("idx").alias("s_idx"), *[F.col(c).alias(f"{end}_{c}") for c in ("name", "lat", "lng")])
        rows = rows.join(s, (F.col("route") == F.col("s_route")) & (F.col(end) == F.col("s_idx")), "left").drop("s_route", "s_idx")
    rows = rows.join(lines.select(F.col("route").alias("l_route"), "number", F.col("name").alias("line"), "fare"), F.col("route") == F.col("l_route"), "left").drop("l_route")
    n = F.col("alight") - F.col("board")
    rows = rows.withColumn("stops", n.cast("long")).withColumn("minutes", F.greatest(n * STOP_MINUTES, F.col("least")).cast("long")).drop("least")
    if shapes is None:
        return rows
    rows = rows.join(shapes.select(F.col("route").alias("g_route"), "points"), F.col("route") == F.col("g_route"), "left").drop("g_route")
    near = [nearest_vertex(F.col("points"), F.col(f"{end}_lat"), F.col(f"{end}_lng")) for end in ("board", "alight")]
    return rows.withColumn("shape", F.when(F.size("points") > 1, between_vertices(F.col("points"), *near))).drop("points")


def materialised(found: DataFrame, queries: DataFrame, stops: DataFrame, lines: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """The journeys with ``rides`` (in order), ``walks`` (origin, between rides, destination) and ``fare_text``; results of ``ranked`` are few, and so are the rides of one.

    ``queries`` has origin and destination labels besides the coordinates (o_label, d_label).
    """
    rows = rides_of(found, stops, lines, shapes)
    parts = [c for c in rows.columns if c not in ("query_id", "journey")]
    ordered = rows.groupBy("query_id", "journey").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("rides"))
    out = found.join(ordered, ["query_id", "journey"]).join(queries.select("query_id", "o_label", "d_label", "o_lat", "o_lng", "d_lat", "d_lng"), "query_id")
    first, last = F.element_at("rides", 1), F.element_at("rides", -1)
    at = lambda r, end: (r[f"{end}_lat"], r[f"{end}_lng"])
    start = walking_leg(F.lit("origin"), F.col("o_label"), first["board_name"], (F.col("o_lat"), F.col("o_lng")), at(first, "board"))
    goal = walking_leg(F.lit("destination"), last["alight_name"], F.col("d_label"), at(last, "alight"), (F.col("d_lat"), F.col("d_lng")))
    pairs = F.arrays_zip(F.slice("rides", F.lit(1), F.size("rides") - 1).alias("a"), F.slice("rides", F.lit(2), F.size("rides") - 1).alias("b"))
    middle = F.transform(pairs, lambda p: walking_leg(F.lit("transfer"), p["a"]["alight_name"], p["b"]["board_name"], at(p["a"], "alight"), at(p["b"], "board")))
    out = out.withColumn("walks", F.concat(F.array(start), middle, F.array(goal))).withColumn("fare_text", fare_summary(F.col("rides.fare")))
    return out.drop("o_label", "d_label", "o_lat", "o_lng", "d_lat", "d_lng")


def leg_totals(rides: Column, stops: str = "stops", kilometres: str = "kilometres") -> Column:
    """struct<stops, kilometres>: the sum of stops (null if 0), and that of the segments' kilometres to 0.1 if every ride has a positive one."""
    count = F.aggregate(rides, F.lit(0).cast("long"), lambda acc, r: acc + F.coalesce(r[stops].cast("long"), F.lit(1)))
    whole = F.aggregate(rides, F.lit(0.0), lambda acc, r: acc + r[kilometres])
    known = (F.size(rides) > 0) & F.forall(rides, lambda r: F.coalesce((r[kilometres] > 0) & ~F.isnan(r[kilometres]), F.lit(False)))
    return F.struct(F.when(count > 0, count).alias("stops"), F.when(known, geo.half_up(whole, 10.0)).alias("kilometres"))
