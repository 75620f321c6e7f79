"""Rebuilding a catalog after directions were promoted on evidence: stops from their resolution, shapes with their provenance, and the compact summary of every route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import geometry
from ..sources.stored import stored

#: Sources of a shape, what is said of a direction without reasons, and of a valid shape without a text.
VERIFIED_SOURCE, UNRESOLVED = "osm_osrm_verified", "unresolved"
NO_REASON, PASSED = "Data ceiling constraint", "Validation PASS"
KEYS = ["route", "direction"]
#: What a verified stop takes from its resolution; others have none of it.
RESOLVED = ["lat", "lng", "source", "node_id", "display_name", "node_type"]


def line(route: Column, direction: Column) -> Column:
    return F.concat_ws("_", route.cast("string"), direction)


def rebuilt_stops(listed: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Every listed stop (route, direction, ordinal, name, street) with status, confidence, method and the values of RESOLVED from its resolution (route, direction, ordinal, status, confidence, method and RESOLVED); what isn't verified is unresolved, without a place."""
    r = resolutions.where("status = 'verified'").select(*KEYS, "ordinal", "confidence", "method", *RESOLVED, F.lit(True).alias("is_verified"))
    rows = listed.select(*KEYS, "ordinal", "name", "street").join(r, [*KEYS, "ordinal"], "left")
    word = lambda c: F.when(F.col("is_verified"), F.col(c)).otherwise(F.lit(UNRESOLVED)).alias(c)
    return rows.select(*KEYS, "ordinal", "name", "street", *RESOLVED, word("confidence"), word("method"), F.when(F.col("is_verified"), F.lit("verified")).otherwise(F.lit(UNRESOLVED)).alias("status"))


def rebuilt_shapes(evaluations: DataFrame, stops: DataFrame, existing: DataFrame, was_verified: DataFrame, fetched: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, provenance) of the evaluated directions (route, direction, is_promoted, reasons, validation).

    A promoted direction keeps its stored line (route, direction, at, lat, lng) if ``was_verified`` (route, direction) has it and it is still valid for the verified stops, else takes the fetched one. All others
    have no points, and their reasons as provenance. ``expected`` has route, direction and kilometres.
    """
    one = lambda df, *cols: df.select(line(F.col("route"), F.col("direction")).alias("line"), *cols)
    promoted = stored(evaluations.where("is_promoted").select(*KEYS).distinct(), "promoted")
    old = existing.join(promoted, KEYS, "left_semi").join(was_verified.select(*KEYS), KEYS, "left_semi")
    anchors = stops.where("status = 'verified'").join(promoted, KEYS, "left_semi")
    judged = geometry.validated(one(old, "at", "lat", "lng"), one(anchors, F.col("ordinal").alias("at"), "name", "lat", "lng"), "line", None if expected is None else one(expected, "kilometres"))
    kept = stored(judged.where("valid").select("line"), "kept")
    keyed = lambda df: df.withColumn("line", line(F.col("route"), F.col("direction")))
    shape = [*KEYS, "at", "lat", "lng"]
    points = keyed(old).join(kept, "line", "left_semi").select(shape).unionByName(keyed(fetched.join(promoted, KEYS, "left_semi")).join(kept, "line", "left_anti").select(shape))
    points = stored(points, "points")
    sizes = points.groupBy(*KEYS).agg(F.count("*").alias("n"))
    rows = evaluations.join(sizes, KEYS, "left")
    why = F.when(F.size(F.coalesce("reasons", F.array().cast("array<string>"))) > 0, F.array_join("reasons", "; ")).otherwise(F.lit(NO_REASON))
    is_promoted = F.coalesce("is_promoted", F.lit(False))
    provenance = rows.select(
        *KEYS, F.when(is_promoted, F.lit(VERIFIED_SOURCE)).otherwise(F.lit(UNRESOLVED)).alias("source"), F.when(is_promoted, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("n_points"), is_promoted.alias("verified"),
        F.when(is_promoted, F.coalesce("validation", F.lit(PASSED))).alias("validation"), F.when(~is_promoted, why).alias("reason"),
    )
    return points, provenance


def compact(routes: DataFrame, stops: DataFrame, points: DataFrame, streets: DataFrame) -> DataFrame:
    """Every route (route and any fields) with the number of its stops and whether it has a shape, outbound and inbound, and the sorted distinct streets of both directions (route, street)."""
    side = lambda d: F.col("direction") == d
    numbers = stops.groupBy("route").agg(*[F.count_if(side(d)).alias(f"{d}_stops") for d in ("outbound", "inbound")])
    shapes = points.groupBy("route").agg(*[F.bool_or(side(d)).alias(f"{d}_geometry") for d in ("outbound", "inbound")])
    names = streets.where(F.col("street").isNotNull()).select("route", "street").distinct().groupBy("route").agg(F.array_sort(F.collect_list("street")).alias("streets"))
    rows = routes.join(numbers, "route", "left").join(shapes, "route", "left").join(names, "route", "left")
    filled = {f"{d}_stops": F.coalesce(f"{d}_stops", F.lit(0)) for d in ("outbound", "inbound")} | {f"{d}_geometry": F.coalesce(f"{d}_geometry", F.lit(False)) for d in ("outbound", "inbound")}
    return rows.withColumns(filled | {"streets": F.coalesce("streets", F.array().cast("array<string>"))})


@dataclass
class Catalog:
    """What a rebuild gives; the provenance says why directions have no shape."""

    stops: DataFrame
    points: DataFrame
    provenance: DataFrame
    summary: DataFrame


def rebuilt(routes: DataFrame, listed: DataFrame, resolutions: DataFrame, evaluations: DataFrame, existing: DataFrame, was_verified: DataFrame, fetched: DataFrame, streets: DataFrame, expected: DataFrame | None = None) -> Catalog:
    """The whole rebuild; the parts of directions that weren't evaluated are not touched here (union them with what this returns). Arguments as in the functions above."""
    stops = stored(rebuilt_stops(listed, resolutions), "stops")
    points, provenance = rebuilt_shapes(evaluations, stops, existing, was_verified, fetched, expected)
    return Catalog(stops, points, provenance, compact(routes, stops, points, streets))
