"""Validity in time and next departures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clock

#: The zone in which dates without a time are read.
ZONE = "+07:00"
OVERRIDE = "array<struct<type:string,effective_from:string,effective_to:string,source_url:string,last_verified_at:string,verification_status:string,affected_directions:array<string>,status_override:string,has_replacement_truth:boolean>>"


def instant(text: Column, end_of_day: bool = False) -> Column:
    """An ISO time, or a date's first (or last) millisecond in ZONE; null if it is neither."""
    only_date = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    day = F.concat(text, F.lit("T23:59:59.999" if end_of_day else "T00:00:00.000"), F.lit(ZONE))
    return F.try_to_timestamp(F.when(only_date, day).otherwise(text))


def proven(source_url: Column, last_verified_at: Column, verification_status: Column) -> Column:
    fine = source_url.startswith("http") & last_verified_at.isNotNull() & (verification_status == "verified")
    return F.coalesce(fine, F.lit(False))


def verdicts(overrides: Column, at: Column, direction: Column) -> Column:
    """For each override in order: malformed_override, skip, unverified_override, suspended, detour_unverified or active."""

    def one(o: Column) -> Column:
        begin, end = instant(o["effective_from"]), instant(o["effective_to"], True)
        listed = F.coalesce(o["affected_directions"], F.array().cast("array<string>"))
        elsewhere = direction.isNotNull() & (F.size(listed) > 0) & ~F.coalesce(F.array_contains(listed, direction), F.lit(False))
        stops = F.coalesce(o["type"] == "suspension", F.lit(False)) | F.coalesce(o["status_override"] == "suspended", F.lit(False))
        return (
            F.when(begin.isNull() | end.isNull() | (begin > end), F.lit("malformed_override"))
            .when((at < begin) | (at > end) | elsewhere, F.lit("skip"))
            .when(~proven(o["source_url"], o["last_verified_at"], o["verification_status"]), F.lit("unverified_override"))
            .when(stops, F.lit("suspended"))
            .when(F.coalesce(o["type"] == "detour", F.lit(False)) & ~F.coalesce(o["has_replacement_truth"], F.lit(False)), F.lit("detour_unverified"))
            .otherwise(F.lit("active"))
        )

    return F.transform(F.coalesce(overrides, F.array().cast(OVERRIDE)), one)


def state(at: Column, *, exists: Column, status: Column, is_active: Column, effective_from: Column, effective_to: Column, source_url: Column, last_verified_at: Column, verification_status: Column, overrides: Column | None = None, direction: Column | None = None) -> Column:
    """The first rule that holds: invalid_time, unknown, unverified, retired, merged, suspended, another status, future, expired, an override's verdict, or active."""
    begin, end = instant(effective_from), instant(effective_to, True)
    found = verdicts(overrides, at, direction if direction is not None else F.lit(None).cast("string")) if overrides is not None else F.array().cast("array<string>")
    stopping = F.try_element_at(F.filter(found, lambda v: ~v.isin("skip", "active")), F.lit(1))
    return (
        F.when(at.isNull(), F.lit("invalid_time"))
        .when(~F.coalesce(exists, F.lit(False)), F.lit("unknown"))
        .when(~proven(source_url, last_verified_at, verification_status), F.lit("unverified"))
        .when(status == "retired", F.lit("retired"))
        .when((status == "merged") & (end.isNull() | (at > end)), F.lit("merged"))
        .when((status == "suspended") | (F.coalesce(is_active, F.lit(True)) == F.lit(False)), F.lit("suspended"))
        .when(status.isNull(), F.lit("unknown"))
        .when(~status.isin("active", "merged"), status)
        .when(begin.isNotNull() & (at < begin), F.lit("future"))
        .when(end.isNotNull() & (at > end), F.lit("expired"))
        .otherwise(F.coalesce(stopping, F.lit("active")))
    )


def usable(state: Column) -> Column:
    """Whether service runs in a state of ``state``: active ones only."""
    return state == "active"


def next_departure(now: Column, trips: Column, start: Column, end: Column, headway: Column, exact: Column, irregular: Column, allow_next_day: Column) -> Column:
    """struct<status, departs (minute of the day or null), wait>. ``trips`` is an array of minutes (nulls are dropped); a timetable wins over hours.

    ``headway`` is null unless a positive number of minutes is known; ``exact`` tells whether departures follow it exactly.
    """
    times = F.array_sort(F.array_compact(F.coalesce(trips, F.array().cast("array<int>"))))
    later = F.try_element_at(F.filter(times, lambda t: t >= now), F.lit(1))
    first = F.try_element_at(times, F.lit(1))
    out = lambda status, at, wait: F.struct(F.lit(status).alias("status"), at.cast("int").alias("departs"), wait.cast("int").alias("wait"))
    nothing = F.lit(None)
    tomorrow = lambda at: F.when(allow_next_day, out("next_day", at, 1440 - now + at)).otherwise(out("after_service", nothing, nothing))
    table = F.when(now < first, out("before_service", first, first - now)).when(later.isNotNull(), out("in_service", later, later - now)).otherwise(tomorrow(first))
    known = start.isNotNull() & end.isNotNull() & (start < end) & (irregular | headway.isNotNull())
    step = start + F.ceil((now - start) / headway).cast("int") * headway
    inside = F.when(irregular | ~exact, out("in_service", nothing, nothing)).when(step <= end, out("in_service", step, step - now))
    after = F.when(irregular, out("after_service", nothing, nothing)).otherwise(tomorrow(start))
    hours = F.when(now < start, F.when(irregular, out("before_service", nothing, nothing)).otherwise(out("before_service", start, start - now))).when(now <= end, F.coalesce(inside, after)).otherwise(after)
    return F.when(now.isNull(), out("unknown", nothing, nothing)).when(F.size(times) > 0, table).when(F.coalesce(known, F.lit(False)), hours).otherwise(out("unknown", nothing, nothing))


def departure_text(result: Column) -> Column:
    return F.concat_ws(" ", result["status"], clock(result["departs"]))
