"""Validation of lines against the places they should pass, and the choice between a stored and a newly fetched line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.stored import stored
from . import spatial
from .quality import LENGTH_RANGE, MAX_OFF, MIN_ANCHORS, MIN_POINTS, PROGRESS_SLACK

#: Codes of the rules, in the order in which they are tested, and what each says.
MISSING, FEW, OFF, BACK, LENGTH = "too_few_points", "too_few_anchors", "anchor_off_line", "progress_not_monotone", "length_out_of_range"
TEXTS = {
    MISSING: "Candidate polyline is missing or too short (< 15 points)",
    FEW: "Not enough verified anchors (%d < 5 minimum)",
    OFF: "Stop '%s' is too far from polyline (%.1fm > 350m)",
    BACK: "Stop order non-monotonic along polyline path (prog %.3f -> %.3f)",
    LENGTH: "Total length %.2fkm deviates from expected %skm",
    None: "Validation PASS (%d anchors, %d points, %.2fkm, max_stop_dist %.1fm)",
}
INSUFFICIENT = "Insufficient anchors (%d < 5 minimum)"


def placed(rows: DataFrame) -> DataFrame:
    return rows.where(geo.valid_coordinate(F.col("lat"), F.col("lng")))


def expected_length(direction: Column, average: Column) -> Column:
    """Kilometres of the direction, or else the average; neither 0 nor null counts."""
    return F.coalesce(F.nullif(direction.cast("double"), F.lit(0.0)), F.nullif(average.cast("double"), F.lit(0.0)))


def validated(points: DataFrame, anchors: DataFrame, line: str = "line", expected: DataFrame | None = None) -> DataFrame:
    """A row for each line that has points or anchors: what was measured, the code of the first rule that fails (null: none), valid and the reason as text.

    ``points`` has line, at, lat, lng; ``anchors`` has line, at, name, lat, lng; ``expected`` has line and kilometres (null or 0: not tested), a line once. Rows without valid coordinates don't count.

    Anchors look for segments of their line within MAX_OFF only, by grid cells. Of those that find none, the first of each line is measured against the whole line, as the rule names it; so
    the work follows the number of segments, however many anchors a line has. Measured: n_points, n_anchors, metres, most_off (over anchors within MAX_OFF), off_name and off_metres, back_from and back_to (the first
    progress that falls by more than PROGRESS_SLACK).
    """
    points, anchors = placed(points), placed(anchors).select(line, F.col("at").alias("a_at"), "name", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    parts = stored(spatial.segments(points, line, "at"), "segments")
    n_points, n_anchors = points.groupBy(line).agg(F.count("*").alias("n_points")), anchors.groupBy(line).agg(F.count("*").alias("n_anchors"))
    lines = stored(n_points.join(n_anchors, line, "full_outer").fillna(0, ["n_points", "n_anchors"]), "lines")
    measured = lines.where((F.col("n_points") >= MIN_POINTS) & (F.col("n_anchors") >= MIN_ANCHORS)).select(line)
    keys = [line, "a_at", "name"]
    tried = stored(spatial.ring_pass(anchors.join(measured, line, "left_semi"), parts, keys, MAX_OFF), "anchors")

    order = F.struct("a_at", "name")
    beyond = tried.where("b IS NULL").groupBy(line).agg(F.min_by(F.struct("a_at", "name", "a_lat", "a_lng"), order).alias("a")).select(line, "a.*")
    off = spatial.nearest_part(beyond.join(parts, line), keys).select(line, F.col("name").alias("off_name"), F.col("b.off").alias("off_metres"))

    whole = parts.groupBy(line).agg(F.sum("metres").alias("metres"))
    progress = tried.where("b IS NOT NULL").join(whole, line).select(*keys, F.coalesce(F.try_divide("b.along", "metres"), F.lit(0.0)).alias("progress"))
    before = progress.withColumn("before", F.lag("progress").over(Window.partitionBy(line).orderBy("a_at", "name")))
    falls = before.where(F.col("progress") < F.col("before") - PROGRESS_SLACK).groupBy(line).agg(F.min_by(F.struct("before", "progress"), order).alias("f"))
    falls = falls.select(line, F.col("f.before").alias("back_from"), F.col("f.progress").alias("back_to"))

    rows = lines.join(whole, line, "left").join(tried.groupBy(line).agg(F.max("b.off").alias("most_off")), line, "left").join(off, line, "left").join(falls, line, "left")
    rows = rows.join(expected.select(line, "kilometres"), line, "left") if expected is not None else rows.withColumn("kilometres", F.lit(None).cast("double"))
    wanted, long = F.nullif(F.col("kilometres").cast("double"), F.lit(0.0)), F.coalesce("metres", F.lit(0.0)) / 1000
    low, high = LENGTH_RANGE
    code = (
        F.when(F.col("n_points") < MIN_POINTS, F.lit(MISSING))
        .when(F.col("n_anchors") < MIN_ANCHORS, F.lit(FEW))
        .when(F.col("off_metres").isNotNull(), F.lit(OFF))
        .when(F.col("back_to").isNotNull(), F.lit(BACK))
        .when(~long.between(low * wanted, high * wanted), F.lit(LENGTH))
    )
    rows = rows.withColumn("code", code).withColumn("valid", F.col("code").isNull())
    said = {MISSING: [], FEW: ["n_anchors"], OFF: ["off_name", "off_metres"], BACK: ["back_from", "back_to"], LENGTH: [long, F.col("kilometres").cast("string")], None: ["n_anchors", "n_points", long, F.coalesce("most_off", F.lit(0.0))]}
    texts = [F.when(F.col("code").eqNullSafe(F.lit(k)), F.format_string(TEXTS[k], *v) if v else F.lit(TEXTS[k])) for k, v in said.items()]
    return rows.withColumn("reason", F.coalesce(*texts))


def chosen(existing: DataFrame, was_verified: DataFrame, fetched: DataFrame, anchors: DataFrame, line: str = "line", expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, points): for each line with anchors the stored line if it was verified and is still valid, else the fetched one if it is valid, else none.

    ``existing`` and ``fetched`` have line, at, lat, lng; ``was_verified`` holds the lines whose stored form counts. Lines with fewer than MIN_ANCHORS anchors get none, and only lines whose
    stored form doesn't do are validated anew. Decisions: line, n_anchors, source (stored, fetched, unresolved), verified, n_points and the validation's reason.
    """
    numbers = stored(placed(anchors).groupBy(line).agg(F.count("*").alias("n_anchors")), "numbers")
    enough = numbers.where(F.col("n_anchors") >= MIN_ANCHORS).select(line)
    old = enough.join(was_verified.select(line), line, "left_semi")
    of = lambda rows, lines: rows.join(lines, line, "left_semi")
    kept = stored(validated(of(existing, old), of(anchors, old), line, expected).where("valid"), "kept")
    open_lines = stored(enough.join(kept, line, "left_anti"), "open")
    new = stored(validated(of(fetched, open_lines), of(anchors, open_lines), line, expected), "fetched")
    answer = lambda rows, source: rows.select(line, F.when(F.col("valid"), F.lit(source)).otherwise(F.lit("unresolved")).alias("source"), F.col("valid").alias("verified"), F.when(F.col("valid"), F.col("n_points")).otherwise(F.lit(0)).alias("n_points"), "reason")
    decided = numbers.join(answer(kept, "stored").unionByName(answer(new, "fetched")), line, "left")
    decisions = decided.select(line, "n_anchors", F.coalesce("source", F.lit("unresolved")).alias("source"), F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("reason", F.format_string(INSUFFICIENT, "n_anchors")).alias("reason"))
    shape = [line, "at", "lat", "lng"]
    return decisions, of(placed(existing), kept).select(*shape).unionByName(of(placed(fetched), new.where("valid")).select(*shape))
