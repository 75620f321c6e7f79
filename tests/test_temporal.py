import pytest
from pyspark.sql import functions as F

from waymark.functions import temporal

BASE = {"status": "active", "is_active": True, "effective_from": None, "effective_to": None, "source_url": "https://example.org", "last_verified_at": "2026-09-30", "verification_status": "verified"}
TYPES = {"is_active": "boolean"}


def state(spark, at, overrides=None, direction=None, exists=True, **fields):
    columns = {k: F.lit(v).cast(TYPES.get(k, "string")) for k, v in (BASE | fields).items()}
    found = temporal.state(F.try_to_timestamp(F.lit(at)), exists=F.lit(exists), overrides=F.from_json(F.lit(overrides), temporal.OVERRIDE) if overrides else None, direction=F.lit(direction).cast("string"), **columns)
    return spark.range(1).select(found.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "at, fields, expected",
    [
        ("x", {}, "invalid_time"),
        ("2026-10-01", {"exists": False}, "unknown"),
        ("2026-10-01T00:00:00Z", {"status": "retired"}, "retired"),
        ("2026-10-01T00:00:00Z", {"status": "merged"}, "merged"),
        ("2026-10-31T23:59:59+07:00", {"effective_from": "2026-11-01T00:00:00+07:00"}, "future"),
        ("2026-11-01T00:00:00+07:00", {"effective_from": "2026-11-01T00:00:00+07:00"}, "active"),
        ("2026-09-02T00:00:01+07:00", {"effective_to": "2026-09-01T23:59:59+07:00"}, "expired"),
        ("2026-09-01T12:00:00+07:00", {"effective_to": "2026-09-01T23:59:59+07:00"}, "active"),
        ("2026-10-01T00:00:00Z", {"source_url": None}, "unverified"),
        ("2026-10-01T00:00:00Z", {"verification_status": "draft"}, "unverified"),
        ("2026-10-01T00:00:00Z", {"is_active": False}, "suspended"),
        ("2025-07-17T23:59:59+07:00", {"status": "merged", "effective_to": "2025-07-17"}, "active"),
        ("2025-07-18T00:00:00+07:00", {"status": "merged", "effective_to": "2025-07-17"}, "merged"),
        ("2025-07-17T23:59:59+07:00", {"effective_from": "2025-07-18"}, "future"),
    ],
)
def test_ladder(spark, at, fields, expected):
    assert state(spark, at, **fields) == expected


def test_bounds_in_utc(spark):
    window = {"effective_from": "2026-09-30T00:00:00+07:00", "effective_to": "2026-09-30T23:59:59+07:00"}
    times = ["2026-09-29T17:00:00Z", "2026-09-29T16:59:59Z", "2026-09-30T16:59:59Z", "2026-09-30T17:00:00Z"]
    assert [state(spark, t, **window) == "active" for t in times] == [True, False, True, False]


PROVEN = '"source_url":"https://example.org","last_verified_at":"2026-09-30","verification_status":"verified"'


@pytest.mark.parametrize(
    "override, at, direction, expected",
    [
        (f'[{{"type":"suspension","effective_from":"2026-10-10","effective_to":"2026-10-12",{PROVEN}}}]', "2026-10-11T00:00:00Z", None, "suspended"),
        (f'[{{"type":"suspension","effective_from":"2026-10-10","effective_to":"2026-10-12",{PROVEN}}}]', "2026-10-13T00:00:00Z", None, "active"),
        (f'[{{"type":"detour","effective_from":"2026-10-01","effective_to":"2026-10-05","affected_directions":["outbound"],{PROVEN}}}]', "2026-10-02T03:00:00Z", "outbound", "detour_unverified"),
        (f'[{{"type":"detour","effective_from":"2026-10-01","effective_to":"2026-10-05","affected_directions":["outbound"],{PROVEN}}}]', "2026-10-02T03:00:00Z", "inbound", "active"),
        (f'[{{"type":"detour","effective_from":"2026-10-01","effective_to":"2026-10-05","has_replacement_truth":true,{PROVEN}}}]', "2026-10-02T03:00:00Z", "outbound", "active"),
        (f'[{{"type":"detour","effective_from":"2026-10-09","effective_to":"2026-10-05",{PROVEN}}}]', "2026-12-01T00:00:00Z", None, "malformed_override"),
        ('[{"type":"detour","effective_from":"2026-10-01","effective_to":"2026-10-05"}]', "2026-10-02T00:00:00Z", None, "unverified_override"),
        ('[{"type":"detour","effective_from":"2026-10-01","effective_to":"2026-10-05"}]', "2026-11-02T00:00:00Z", None, "active"),
    ],
)
def test_overrides(spark, override, at, direction, expected):
    assert state(spark, at, override, direction) == expected


def departure(spark, now, start, end, headway, exact, irregular=False, next_day=True, trips=None):
    lit = lambda x, t="int": F.lit(x).cast(t)
    times = F.array(*[F.lit(t) for t in trips]) if trips else F.lit(None).cast("array<int>")
    r = spark.range(1).select(temporal.next_departure(lit(now), times, lit(start), lit(end), lit(headway), F.lit(exact), F.lit(irregular), F.lit(next_day)).alias("x")).first()["x"]
    return r["status"], r["departs"], r["wait"]


@pytest.mark.parametrize(
    "args, expected",
    [
        ((46, 315, 1110, 15, False), ("before_service", 315, 269)),
        ((480, 315, 1110, 15, False), ("in_service", None, None)),
        ((430, 360, 1080, 30, True), ("in_service", 450, 20)),
        ((1200, 315, 1110, 15, False), ("next_day", 315, 555)),
        ((1200, 315, 1110, 15, False, False, False), ("after_service", None, None)),
        ((1380, 360, 1320, None, False, True), ("after_service", None, None)),
        ((240, 360, 1320, None, False, True), ("before_service", None, None)),
        ((310, None, None, None, False, False, True, [300, 335, 370]), ("in_service", 335, 25)),
        ((1079, 360, 1080, 30, True), ("in_service", 1080, 1)),
        ((1085, 360, 1090, 30, True), ("next_day", 360, 715)),
        ((480, 360, 1080, None, False), ("unknown", None, None)),
        ((None, 360, 1080, 30, False), ("unknown", None, None)),
    ],
)
def test_next_departure(spark, args, expected):
    assert departure(spark, *args) == expected
