"""Data-quality contracts, coverage and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.temporal import proven


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """The texts of the rules that do not hold, joined; empty if all hold. A rule that is null does not hold."""
    return F.concat_ws("; ", F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in rules])))


def with_contract(rows: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Add reasons and eligible."""
    return rows.withColumn("reasons", reasons(rules)).withColumn("eligible", F.col("reasons") == "")


def stop_metrics(stops: DataFrame, keys: list[str], verified: Column) -> DataFrame:
    return stops.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(verified).alias("verified"), F.count_if(~F.coalesce(verified, F.lit(False))).alias("unresolved"))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), 2), F.lit(0.0))


def coverage(rows: DataFrame, keys: list[str], tests: dict[str, Column]) -> DataFrame:
    """Counts of rows, and of those for which each test holds, with percentages."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(t).alias(n) for n, t in tests.items()])
    return counts.select("*", *[percent(F.col(n), F.col("total")).alias(f"{n}_pct") for n in tests])


def drift(stored: DataFrame, computed: DataFrame, keys: list[str], values: list[str], slack: float = 0.0) -> DataFrame:
    """Keys whose values differ (null-safe; numbers by more than ``slack``), or that one side lacks: only_stored, only_computed or changed."""
    s = stored.select(*keys, *[F.col(v).alias(f"stored_{v}") for v in values], F.lit(True).alias("in_stored"))
    c = computed.select(*keys, *[F.col(v).alias(f"computed_{v}") for v in values], F.lit(True).alias("in_computed"))
    both = s.join(c, keys, "full_outer")
    changed = F.lit(False)
    for v in values:
        a, b = F.col(f"stored_{v}"), F.col(f"computed_{v}")
        changed = changed | ~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= slack, F.lit(False)) if slack else a.eqNullSafe(b))
    kind = F.when(F.col("in_computed").isNull(), F.lit("only_stored")).when(F.col("in_stored").isNull(), F.lit("only_computed")).when(changed, F.lit("changed"))
    return both.withColumn("drift", kind).where(F.col("drift").isNotNull()).drop("in_stored", "in_computed")


def fare_ok(kind: Column, flat: Column, single: Column, low: Column, high: Column, tiers: Column) -> Column:
    """A positive flat price; or tiers without a single ticket, whose prices and distances are all positive if there are tiers, else positive bounds in order."""
    good = F.coalesce(F.forall(tiers, lambda t: F.coalesce((t["price"] > 0) & ~F.isnan(t["price"].cast("double")) & (t["distanceMaxKm"].isNull() | (t["distanceMaxKm"] > 0)), F.lit(False))), F.lit(False))
    tiered = single.isNull() & F.when(tiers.isNotNull(), (F.size(tiers) > 0) & good).otherwise(F.coalesce((low > 0) & (high >= low), F.lit(False)))
    return F.coalesce(F.when(kind == "flat", F.coalesce(flat, single) > 0).when(kind == "distance_tiered", tiered), F.lit(False))


#: Limits of a line's geometry: points, anchors, metres off the line, backward progress, length against what is expected.
MIN_POINTS, MIN_ANCHORS, MAX_OFF, PROGRESS_SLACK, LENGTH_RANGE = 15, 5, 350.0, 0.05, (0.6, 1.8)


def geometry_reason(n_points: Column, n_anchors: Column, most_off: Column, most_back: Column, metres: Column, expected: Column) -> Column:
    """The first rule of a line's geometry that fails, or null."""
    low, high = LENGTH_RANGE
    return (
        F.when(F.coalesce(n_points, F.lit(0)) < MIN_POINTS, F.lit("too_few_points"))
        .when(F.coalesce(n_anchors, F.lit(0)) < MIN_ANCHORS, F.lit("too_few_anchors"))
        .when(most_off > MAX_OFF, F.lit("anchor_off_line"))
        .when(most_back > PROGRESS_SLACK, F.lit("progress_not_monotone"))
        .when(expected.isNotNull() & ~(metres / expected).between(low, high), F.lit("length_out_of_range"))
    )


#: Texts of the reasons why a direction or a route is not ready for planning.
FEW_STOPS = ("Chỉ có ", " trạm verified (yêu cầu tối thiểu 2 trạm có tọa độ hợp lệ)")
NOT_RISING = ("Thứ tự trạm dừng verified không tăng đơn điệu (order ", " >= ", ")")
FEW_POINTS, BAD_POINT, UNPROVEN_SHAPE = "Thiếu dữ liệu lộ trình polyline (points < 2)", "Tọa độ polyline không hợp lệ (ngoài phạm vi địa lý hoặc không phải số)", "Lộ trình chưa được xác minh (provenance.verified != true)"
NO_SOURCE = "Thiếu hoặc chưa xác minh nguồn chính thức (sourceUrl, lastVerifiedAt, verificationStatus)"
INACTIVE, ROUTE_INACTIVE = "Tuyến không hoạt động (status=", ("Tuyến ", " tạm ngừng (status=")
SIDES = {"outbound": "Chiều đi chưa sẵn sàng: ", "inbound": "Chiều về chưa sẵn sàng: "}
FARE = "Giá vé chưa sẵn sàng: "
FLAT_PRICE = "Giá vé đồng giá không hợp lệ hoặc thiếu giá"
LOW_PRICE, HIGH_PRICE, REVERSED_PRICES = "Bảng giá theo chặng chứa minPrice không hợp lệ", "Bảng giá theo chặng chứa maxPrice không hợp lệ", "Bảng giá theo chặng có maxPrice nhỏ hơn minPrice"
EMPTY_TIERS, NULL_TIER, TIER_PRICE, TIER_KM = "Bảng giá tiers không hợp lệ (phải là danh sách không rỗng)", "Bảng giá tiers chứa phần tử không phải object", "Bảng giá tiers chứa giá vé không hợp lệ", "Bảng giá tiers chứa khoảng cách distanceMaxKm không hợp lệ"
NO_PRICES, SINGLE_TICKET, UNKNOWN_FARE = "Bảng giá theo chặng thiếu cả min/maxPrice và tiers hợp lệ", "Bảng giá theo chặng vi phạm cấm flat singleTicket", "Loại giá vé không hợp lệ hoặc chưa rõ ("


def fare_reason(kind: Column, flat: Column, single: Column, low: Column, high: Column, tiers: Column) -> Column:
    """Why a fare is not usable, or null: the first rule that fails. ``tiers`` is an array of struct<price, distanceMaxKm>."""
    positive = lambda x: F.coalesce((x > 0) & ~F.isnan(x.cast("double")) & (x.cast("double") != float("inf")), F.lit(False))
    first_bad = F.try_element_at(
        F.filter(
            F.transform(tiers, lambda t: F.when(t.isNull(), F.lit(NULL_TIER)).when(~positive(t["price"]), F.lit(TIER_PRICE)).when(t["distanceMaxKm"].isNotNull() & ~positive(t["distanceMaxKm"]), F.lit(TIER_KM))),
            lambda x: x.isNotNull(),
        ),
        F.lit(1),
    )
    tiered = (
        F.when(low.isNotNull() & ~positive(low), F.lit(LOW_PRICE))
        .when(high.isNotNull() & ~positive(high), F.lit(HIGH_PRICE))
        .when(F.coalesce(low > high, F.lit(False)), F.lit(REVERSED_PRICES))
        .when(tiers.isNotNull() & (F.size(tiers) == 0), F.lit(EMPTY_TIERS))
        .when(first_bad.isNotNull(), first_bad)
        .when(tiers.isNull() & (low.isNull() | high.isNull()), F.lit(NO_PRICES))
        .when(single.isNotNull(), F.lit(SINGLE_TICKET))
    )
    unknown = F.concat(F.lit(UNKNOWN_FARE), F.coalesce(kind, F.lit("None")), F.lit(")"))
    flat_reason = F.when(~positive(F.coalesce(flat, single)), F.lit(FLAT_PRICE))
    return F.when(kind == "flat", flat_reason).when(kind == "distance_tiered", tiered).otherwise(unknown)


def direction_stops(stops: DataFrame) -> DataFrame:
    """route_id, direction, total, verified, unresolved and stop_reason (null if ready): at least two verified stops whose order rises in sequence.

    ``stops``: route_id, direction, pos (place in the list), ord, lat, lng, status. A missing order counts as 0.
    """
    keys = ["route_id", "direction"]
    fine = F.coalesce(F.col("status") == "verified", F.lit(False)) & geo.valid_coordinate(F.col("lat"), F.col("lng"))
    rows = stops.select(*keys, "pos", F.coalesce("ord", F.lit(0)).alias("ord"), fine.alias("fine"))
    steps = rows.where("fine").withColumn("next", F.lead("ord").over(Window.partitionBy(*keys).orderBy("pos"))).where(F.col("next") <= F.col("ord"))
    text = F.concat(F.lit(NOT_RISING[0]), F.col("ord").cast("string"), F.lit(NOT_RISING[1]), F.col("next").cast("string"), F.lit(NOT_RISING[2]))
    back = steps.groupBy(*keys).agg(F.min_by(text, "pos").alias("back"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("fine").alias("verified")).withColumn("unresolved", F.col("total") - F.col("verified"))
    few = F.concat(F.lit(FEW_STOPS[0]), F.col("verified").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(FEW_STOPS[1]))
    return counts.join(back, keys, "left").select(*keys, "total", "verified", "unresolved", F.when(F.col("verified") < 2, few).otherwise(F.col("back")).alias("stop_reason"))


def direction_shapes(points: DataFrame, proofs: DataFrame) -> DataFrame:
    """route_id, direction and shape_reason (null if ready): two points or more, all with valid coordinates, and a proof. ``proofs``: route_id, direction, verified."""
    keys = ["route_id", "direction"]
    counted = points.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(geo.valid_coordinate(F.col("lat"), F.col("lng"))).alias("valid"))
    both = counted.join(proofs.select(*keys, F.coalesce("verified", F.lit(False)).alias("proved")), keys, "full_outer")
    reason = F.when(F.coalesce("n", F.lit(0)) < 2, F.lit(FEW_POINTS)).when(~F.col("valid"), F.lit(BAD_POINT)).when(~F.coalesce("proved", F.lit(False)), F.lit(UNPROVEN_SHAPE))
    return both.select(*keys, reason.alias("shape_reason"))


def direction_quality(routes: DataFrame, stops: DataFrame, points: DataFrame, proofs: DataFrame) -> DataFrame:
    """One row for each route and direction (outbound, inbound): stop counts, stops_ready, shape_ready, eligible, reason, and the route's own fields.

    ``routes``: route_id, status, source_url, last_verified_at, verification_status, fare_reason (see ``fare_reason``).
    """
    keys = ["route_id", "direction"]
    sides = routes.withColumn("direction", F.explode(F.array(*[F.lit(d) for d in SIDES])))
    rows = sides.join(direction_stops(stops), keys, "left").join(direction_shapes(points, proofs), keys, "left").na.fill(0, ["total", "verified", "unresolved"])
    none = F.concat(F.lit(FEW_STOPS[0] + "0/0" + FEW_STOPS[1]))
    rows = rows.withColumn("stop_reason", F.when(F.col("total") == 0, none).otherwise(F.col("stop_reason")))
    # a direction that neither the points nor the proofs name has no shape
    shaped = direction_shapes(points, proofs).select(*keys, F.lit(True).alias("has_shape"))
    rows = rows.join(shaped, keys, "left").withColumn("shape_reason", F.when(F.col("has_shape").isNull(), F.lit(FEW_POINTS)).otherwise(F.col("shape_reason"))).drop("has_shape")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    sourced = proven(F.col("source_url"), F.col("last_verified_at"), F.col("verification_status"))
    rows = rows.withColumn("active", active).withColumn("sourced", sourced)
    rules = [(F.col("active"), F.concat(F.lit(INACTIVE), F.coalesce("status", F.lit("None")), F.lit(")"))), (F.col("sourced"), F.lit(NO_SOURCE)), (F.col("stop_reason").isNull(), F.col("stop_reason")), (F.col("shape_reason").isNull(), F.col("shape_reason")), (F.col("fare_reason").isNull(), F.col("fare_reason"))]
    why = F.concat_ws("; ", F.array_compact(F.array(*[F.when(~test, text) for test, text in rules])))
    rows = rows.withColumn("reason", why).withColumn("eligible", F.col("reason") == "")
    return rows.withColumn("stops_ready", F.col("stop_reason").isNull()).withColumn("shape_ready", F.col("shape_reason").isNull()).withColumn("reason", F.when(~F.col("eligible"), F.col("reason")))


def route_quality(directions: DataFrame) -> DataFrame:
    """route_id, planning_ready and reasons (an array, empty if ready) from ``direction_quality``."""
    side = lambda d, c: F.max(F.when(F.col("direction") == d, F.col(c)))
    rows = directions.groupBy("route_id").agg(
        *[F.first(c).alias(c) for c in ("status", "active", "sourced", "fare_reason")], *[side(d, c).alias(f"{d}_{c}") for d in SIDES for c in ("eligible", "reason")]
    )
    parts = [
        F.when(~F.col("active"), F.concat(F.lit(ROUTE_INACTIVE[0]), F.col("route_id").cast("string"), F.lit(ROUTE_INACTIVE[1]), F.coalesce("status", F.lit("None")), F.lit(")"))),
        F.when(~F.col("sourced"), F.lit(NO_SOURCE)),
        *[F.when(~F.col(f"{d}_eligible"), F.concat(F.lit(text), F.col(f"{d}_reason"))) for d, text in SIDES.items()],
        F.when(F.col("fare_reason").isNotNull(), F.concat(F.lit(FARE), F.col("fare_reason"))),
    ]
    return rows.select("route_id", F.array_compact(F.array(*parts)).alias("reasons")).withColumn("planning_ready", F.size("reasons") == 0)


def coverage_lists(routes: DataFrame, key: str, classes: list[tuple[Column, str]], ordinal: str) -> DataFrame:
    """class, n, pct (two decimals) and the ids of each class in order; a row belongs to the first class that holds, or to ``other``. A report over a catalog's routes."""
    kind = F.lit("other")
    for test, name in reversed(classes):
        kind = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(kind)
    rows = routes.select(F.col(key).alias("id"), F.col(ordinal).alias("at"), kind.alias("class"))
    total = rows.agg(F.count("*").alias("all"))
    found = rows.groupBy("class").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", "id")))["id"].alias("ids"))
    return found.crossJoin(F.broadcast(total)).select("class", "n", percent(F.col("n"), F.col("all")).alias("pct"), "ids")


def temporal_audit(routes: DataFrame) -> DataFrame:
    """route_id, is_bounded and valid_dates: whether a start or an end is given, and whether those given are ISO dates or times."""
    iso = lambda c: (F.coalesce(F.col(c), F.lit("")) == "") | F.try_to_timestamp(F.col(c)).isNotNull()
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return routes.select("route_id", (given("effective_from") | given("effective_to")).alias("is_bounded"), (iso("effective_from") & iso("effective_to")).alias("valid_dates"))


#: Lifecycle states that are counted.
STATES = ("active", "suspended", "merged", "retired")


def reconciliation(routes: DataFrame, evidence: Column, overrides: DataFrame, conflicts: int | Column = 0, issues: int | Column = 0) -> DataFrame:
    """The counters of a reconciliation in one row, by one pass over the routes and one over the overrides.

    ``routes``: status, source_url, last_verified_at, verification_status, planning_ready; ``evidence`` tells routes with explicit evidence; ``overrides`` has
    ``problem``, null if valid; conflicts of aliases and issues of references are counted by ``identity``.
    """
    sourced = proven(F.col("source_url"), F.col("last_verified_at"), F.col("verification_status"))
    verified = F.coalesce(F.col("verification_status") == "verified", F.lit(False))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    one = routes.agg(
        F.count("*").alias("total"), *[count(F.col("status") == s).alias(s) for s in STATES], count(sourced).alias("with_provenance"), count(verified).alias("verified"), count(~verified).alias("unverified"),
        count(F.col("planning_ready")).alias("planning_ready"), count(~F.coalesce(evidence & sourced, F.lit(False))).alias("evidence_gaps"),
    )
    two = overrides.agg(F.count("*").alias("overrides"), F.count_if(F.col("problem").isNull()).alias("valid_overrides"), F.count_if(F.col("problem").isNotNull()).alias("invalid_overrides"))
    fixed = lambda x: x if isinstance(x, Column) else F.lit(x).cast("long")
    return one.crossJoin(two).withColumn("provenance_pct", percent(F.col("with_provenance"), F.col("total"))).withColumn("alias_conflicts", fixed(conflicts)).withColumn("reference_issues", fixed(issues))


def checked(report: DataFrame, stored: DataFrame, counters: list[str]) -> None:
    """Compare counters of a one-row report with a stored one; raises with the differences."""
    a, b = (df.select(*counters).first() for df in (report, stored))
    wrong = {c: (a[c] if a else None, b[c] if b else None) for c in counters if (a[c] if a else None) != (b[c] if b else None)}
    if wrong:
        raise ValueError(f"report differs (computed, stored): {wrong}")
