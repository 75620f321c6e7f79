"""Joins by distance, and geometry of polylines. Grid cells make distance joins equi-joins; only neighbouring cells meet."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.stored import stored

METRES_PER_DEGREE = 111_000.0


def with_cell(df: DataFrame, lat: str, lng: str, metres: float, greatest_lat: float = 85.0) -> DataFrame:
    """Add cell_y and cell_x of a grid whose cells are at least ``metres`` wide up to latitude ``greatest_lat``."""
    high = max(metres, 1.0) / METRES_PER_DEGREE
    wide = high / math.cos(math.radians(greatest_lat))
    return df.withColumn("cell_y", F.floor(F.col(lat) / high)).withColumn("cell_x", F.floor(F.col(lng) / wide))


def around(df: DataFrame) -> DataFrame:
    """Each row in its own cell and the eight around it."""
    steps = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    return df.withColumn("step", F.explode(steps)).withColumn("cell_y", F.col("cell_y") + F.col("step.y")).withColumn("cell_x", F.col("cell_x") + F.col("step.x")).drop("step")


def within(left: DataFrame, right: DataFrame, metres: float, left_at: tuple[str, str], right_at: tuple[str, str], greatest_lat: float = 30.0, crowd: int | None = None, spread: str = "right", weight: str | None = None) -> DataFrame:
    """Pairs of rows at most ``metres`` apart, with ``metres``; rows without valid coordinates, or beyond ``greatest_lat``, match nothing. The rows of the side ``spread`` (best the smaller one) stand in the cells around theirs as well.

    With ``crowd`` the right rows that meet in a cell are counted first (by their ``weight``), and cells with more than so many are cut into pieces of about that size, each a join key of its own, so that a crowded cell is spread over tasks.
    """
    fine = lambda df, at: df.where(geo.valid_coordinate(F.col(at[0]), F.col(at[1])) & (F.abs(F.col(at[0])) <= greatest_lat))
    a = with_cell(fine(left, left_at), *left_at, metres, greatest_lat)
    b = with_cell(fine(right, right_at), *right_at, metres, greatest_lat)
    a, b = (around(a), b) if spread == "left" else (a, around(b))
    distance = geo.haversine(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    cell = ["cell_y", "cell_x"]
    keys = cell
    if crowd is not None:
        counts = b.groupBy(*cell).agg(F.sum(weight or F.lit(1)).alias("count")).where(F.col("count") > crowd)
        crowded = stored(counts.select(*cell, F.ceil(F.col("count") / crowd).cast("int").alias("pieces")), "crowded")
        if not crowded.isEmpty():
            keys, pieces = [*cell, "piece"], F.coalesce("pieces", F.lit(1))
            mixed = F.xxhash64(*[F.col(c) for c in right.columns if c not in cell and "map<" not in dict(right.dtypes)[c]])
            a = a.join(crowded, cell, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
            b = b.join(crowded, cell, "left").withColumn("piece", F.pmod(mixed, pieces).cast("int")).drop("pieces")
    return a.join(b, keys).drop(*keys).withColumn("metres", distance).where(F.col("metres") <= metres)


def ranked_by_distance(found: DataFrame, point: list[str], place_id: str, limit: int) -> DataFrame:
    by = Window.partitionBy(*point).orderBy("metres", place_id)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def nearest(points: DataFrame, places: DataFrame, point_id: str, place_id: str, metres: float, limit: int, point_at: tuple[str, str], place_at: tuple[str, str], crowd: int | None = None) -> DataFrame:
    """The ``limit`` nearest places within ``metres`` of each point, ranked by distance and id. A point has one position; points that share one are looked up once, and of places that share one the first ``limit`` count.

    With ``crowd``, where a cell holds more places than that, the search begins with smaller cells: a point that has ``limit`` places within a sixteenth or a fourth of ``metres`` looks no further, so it meets
    a number of places that follows ``limit`` and not the density.
    """
    spot = list(point_at)
    spots = stored(points.where(geo.valid_coordinate(*map(F.col, spot))).select(*spot).distinct(), "spots")
    first = Window.partitionBy(*place_at).orderBy(place_id)
    kept = stored(places.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit).drop("rank"), "places")
    best = nearest_of_spots(spots, kept, spot, place_id, metres, limit, point_at, place_at, crowd)
    return points.join(best, spot).select(*points.columns, *places.columns, "metres", "rank")


def nearest_of_spots(spots: DataFrame, places: DataFrame, spot: list[str], place_id: str, metres: float, limit: int, point_at: tuple[str, str], place_at: tuple[str, str], crowd: int | None) -> DataFrame:
    if crowd is None or with_cell(places, *place_at, metres).groupBy("cell_y", "cell_x").count().where(F.col("count") > crowd).isEmpty():
        return ranked_by_distance(within(spots, places, metres, point_at, place_at), spot, place_id, limit)
    found, left = [], spots
    for part in (16, 4):
        near = stored(ranked_by_distance(within(left, places, metres / part, point_at, place_at), spot, place_id, limit), "near")
        full = near.where(F.col("rank") == limit).select(*spot)
        found.append(near.join(full, spot, "left_semi"))
        left = left.join(full, spot, "left_anti")
    found.append(ranked_by_distance(within(left, places, metres, point_at, place_at, crowd=crowd), spot, place_id, limit))
    return reduce(DataFrame.unionByName, found)


#: Rows of one position that a heap holds at most, but for the chance of a hash.
HEAP = 64


def heaped(rows: DataFrame, at: tuple[str, str], name: str) -> DataFrame:
    """One row for each position, or part of a crowded one: the coordinates ``at``, ``<name>_rows`` with its rows, and how many they are (``<name>_n``)."""
    others = [c for c in rows.columns if c not in at]
    fine = rows.where(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull())
    counts = fine.groupBy(*at).agg(F.ceil(F.count("*") / HEAP).alias("heaps"))
    mixed = F.xxhash64(*[c for c in others if "map<" not in dict(rows.dtypes)[c]])
    dealt = fine.join(counts, [*at]).withColumn("heap", F.pmod(mixed, "heaps"))
    return dealt.groupBy(*at, "heap").agg(F.collect_list(F.struct(*others)).alias(f"{name}_rows")).drop("heap").withColumn(f"{name}_n", F.size(f"{name}_rows"))


def transfers(stops: DataFrame, metres: float = 400.0, crowd: int | None = None, leaving: DataFrame | None = None, entering: DataFrame | None = None) -> DataFrame:
    """Edges between stops of different routes at most ``metres`` apart, with whole metres. ``stops``: route, stop, lat, lng; ``crowd`` as in ``within``.

    ``leaving`` and ``entering`` (route) keep the edges from and to these routes alone, without looking at others. Without them stops of one position are measured once, as a heap.
    """
    side = lambda x: stops.select(*[F.col(c).alias(f"{x}_{c}") for c in stops.columns])
    few = lambda x, routes: side(x) if routes is None else side(x).join(routes.select(F.col("route").alias(f"{x}_route")).distinct(), f"{x}_route", "left_semi").select(*side(x).columns)
    at = {x: (f"{x}_lat", f"{x}_lng") for x in ("from", "to")}
    if leaving is not None or entering is not None:
        pairs = within(few("from", leaving), few("to", entering), metres, at["from"], at["to"], crowd=crowd, spread="right" if leaving is None else "left")
    else:
        met = within(heaped(side("from"), at["from"], "from"), heaped(side("to"), at["to"], "to"), metres, at["from"], at["to"], crowd=crowd, weight="to_n")
        for x in ("from", "to"):
            others = [f"{y}_{c}" for y in ("from", "to") for c in stops.columns if f"{y}_{c}" in met.columns]
            kept = [*others, "metres", *([] if x == "to" else ["to_rows"])]
            met = met.select(*kept, F.inline(f"{x}_rows"))
        pairs = met.select(*side("from").columns, *side("to").columns, "metres")
    return pairs.where(F.col("from_route") != F.col("to_route")).withColumn("metres", geo.half_up(F.col("metres")).cast("long"))


def segments(points: DataFrame, line: str, at: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Consecutive points of each line: seq, lat, lng, next_lat, next_lng, metres and the metres ``before`` the segment."""
    by = Window.partitionBy(line).orderBy(at)
    rows = points.select(line, F.col(at).alias("seq"), F.col(lat).alias("lat"), F.col(lng).alias("lng"), F.lead(lat).over(by).alias("next_lat"), F.lead(lng).over(by).alias("next_lng"))
    rows = rows.withColumn("metres", geo.exact_haversine(F.col("lat"), F.col("lng"), F.col("next_lat"), F.col("next_lng")))
    before = F.sum("metres").over(Window.partitionBy(line).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("next_lat").isNotNull())


def lengths(points: DataFrame, line: str, at: str) -> DataFrame:
    """Points and metres of each line."""
    return segments(points, line, at).groupBy(line).agg((F.count("*") + 1).alias("n_points"), F.sum("metres").alias("metres"))


#: Metres around an anchor in which its line is looked for, one ring after the other.
RINGS = (350.0, 2_800.0, 22_400.0)


def rasterised(parts: DataFrame, metres: float, greatest_lat: float) -> DataFrame:
    """Segments in the cells that they pass. Points of a segment are taken ``metres`` apart at most and cells are 1.6 times as wide, so whatever lies within ``metres`` of the segment has one of its cells next to its own."""
    steps = F.greatest(F.lit(1), F.ceil(F.coalesce("metres", F.lit(0.0)) / metres)).cast("int")
    high = 1.6 * metres / METRES_PER_DEGREE
    wide = high / math.cos(math.radians(greatest_lat))
    along = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / steps
    cells = F.array_distinct(F.transform(F.sequence(F.lit(0), steps), lambda k: F.struct(F.floor(along("lat", "next_lat", k) / high).alias("cell_y"), F.floor(along("lng", "next_lng", k) / wide).alias("cell_x"))))
    return parts.withColumn("cell", F.explode(cells)).select(*parts.columns, "cell.cell_y", "cell.cell_x")


def nearest_part(met: DataFrame, keys: list[str]) -> DataFrame:
    """Of anchors (keys, a_lat, a_lng) that met segments: the keys and b, the nearest segment (off, along in metres, seq); the first among equals."""
    near = geo.point_to_segment(F.col("a_lat"), F.col("a_lng"), F.col("lat"), F.col("lng"), F.col("next_lat"), F.col("next_lng"))
    found = F.struct(F.col("near.metres").alias("off"), (F.col("before") + F.col("near.t") * F.col("metres")).alias("along"), "seq")
    return met.withColumn("near", near).groupBy(*keys).agg(F.min_by(found, F.struct("near.metres", "seq")).alias("b"))


def ring_pass(anchors: DataFrame, parts: DataFrame, keys: list[str], metres: float, greatest_lat: float = 60.0) -> DataFrame:
    """The anchors (keys, the first of which is the line, a_lat, a_lng) with b, the nearest segment of their line if it is within ``metres``. Anchors beyond ``greatest_lat`` get none."""
    seen = with_cell(anchors.where(F.abs("a_lat") <= greatest_lat), "a_lat", "a_lng", 1.6 * metres, greatest_lat)
    best = nearest_part(around(seen).join(rasterised(parts, metres, greatest_lat), [keys[0], "cell_y", "cell_x"]), keys).where(F.col("b.off") <= metres)
    return anchors.join(best, keys, "left")


def onto_line(anchors: DataFrame, parts: DataFrame, line: str, anchor: str, rings: tuple[float, ...] = RINGS) -> DataFrame:
    """For each anchor (line, anchor, a_lat, a_lng) the distance to its line and the progress (0 to 1) of the nearest point; ties go to the first segment.

    Segments are met by grid cells in growing rings; only anchors with nothing in the last ring meet all segments of their line.
    """
    parts, keys = stored(parts, "segments"), [line, anchor]
    left = anchors.select(*keys, "a_lat", "a_lng")
    whole = parts.groupBy(F.col(line).alias("w")).agg(F.sum("metres").alias("whole"))
    found: list[DataFrame] = []
    for ring in rings:
        tried = stored(ring_pass(left, parts, keys, ring), "ring")
        found.append(tried.where("b IS NOT NULL").select(*keys, "b"))
        left = tried.where("b IS NULL").select(*left.columns)
        if left.isEmpty():
            break
    else:
        found.append(nearest_part(left.join(parts, line), keys))
    best = reduce(DataFrame.unionByName, found)
    return best.join(whole, F.col(line) == F.col("w")).select(*keys, F.col("b.off").alias("metres_off"), F.col("b.seq").alias("segment"), F.coalesce(F.try_divide("b.along", "whole"), F.lit(0.0)).alias("progress"))


def nearest_vertex(points: Column, lat: Column, lng: Column) -> Column:
    """Index of the vertex with the least squared difference in degrees, the first among equals; 0 without input."""
    ranked = F.transform(points, lambda p, i: F.struct(((p["lat"] - lat) * (p["lat"] - lat) + (p["lng"] - lng) * (p["lng"] - lng)).alias("d"), i.alias("i")))
    usable = F.filter(ranked, lambda r: r["d"].isNotNull())
    return F.when(F.coalesce(F.size(usable) > 0, F.lit(False)), F.array_min(usable)["i"]).otherwise(F.lit(0))


def between_vertices(points: Column, first: Column, last: Column) -> Column:
    """The polyline from one vertex to another, or null if that runs backwards."""
    return F.when(last >= first, F.slice(points, first + 1, last - first + 1))
