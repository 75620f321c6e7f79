"""The geometry validator and the choice of lines against loops over every anchor and segment."""

import math
import random

import pytest

from waymark.operators import geometry, spatial

POINTS, ANCHORS = "line string, at int, lat double, lng double", "line string, at int, name string, lat double, lng double"


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def project(lat, lng, line):
    """(distance, segment, progress) of a point on a list of points."""
    sizes = [metres(*p, *q) for p, q in zip(line, line[1:])]
    best = (math.inf, None, None)
    for k, ((a, b), (c, d)) in enumerate(zip(line, line[1:])):
        wide, high = 111_320 * math.cos(math.radians(lat)), 110_540
        x1, y1, x2, y2 = (b - lng) * wide, (a - lat) * high, (d - lng) * wide, (c - lat) * high
        dx, dy = x2 - x1, y2 - y1
        t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy)))
        off = math.hypot(x1 + t * dx, y1 + t * dy)
        if off < best[0]:
            best = (off, k, (sum(sizes[:k]) + t * sizes[k]) / (sum(sizes) or 1.0))
    return best


def judge(line, anchors, km):
    if len(line) < 15:
        return "too_few_points"
    if len(anchors) < 5:
        return "too_few_anchors"
    seen = [project(a[3], a[4], line) for a in sorted(anchors, key=lambda a: (a[1], a[2]))]
    if any(off > 350 for off, _, _ in seen):
        return "anchor_off_line"
    if any(b < a - 0.05 for (_, _, a), (_, _, b) in zip(seen, seen[1:])):
        return "progress_not_monotone"
    whole = sum(metres(*p, *q) for p, q in zip(line, line[1:])) / 1000
    return "length_out_of_range" if km and not 0.6 * km <= whole <= 1.8 * km else None


def random_lines(r, n):
    points, anchors, expected = [], [], []
    for i in range(n):
        name, lat, lng, line = f"l{i}", 16.0 + r.random() / 5, 108.0 + r.random() / 5, []
        for k in range(r.choice([8, 15, 40])):
            lat, lng = lat + r.uniform(-0.002, 0.006), lng + r.uniform(-0.02 if k % 9 == 0 else 0, 0.006)
            line.append((lat, lng))
        points += [(name, k, *p) for k, p in enumerate(line)]
        own = sorted(r.sample(range(len(line)), r.choice([3, 6, 8])))
        if r.random() < 0.3:
            r.shuffle(own)
        anchors += [(name, k, f"s{k}", line[p][0] + r.choice([0.001, 0.003, 0.01 if r.random() < 0.2 else 0.0]), line[p][1]) for k, p in enumerate(own)]
        expected.append((name, r.choice([None, 0.0, 5.0, 10.0, 20.0, 200.0])))
    return points, anchors, expected


def test_lines_are_judged_as_by_loops(spark):
    points, anchors, expected = random_lines(random.Random(1), 60)
    table = geometry.validated(spark.createDataFrame([*points, ("l0", 99, None, 1.0), ("l1", 99, 95.0, 1.0)], POINTS), spark.createDataFrame([*anchors, ("l0", 99, "x", None, 1.0)], ANCHORS), "line", spark.createDataFrame(expected, "line string, kilometres double"))
    found = {r["line"]: r for r in table.collect()}
    kilometres = dict(expected)
    codes = set()
    for name in kilometres:
        line, own = [p[2:] for p in points if p[0] == name], [a for a in anchors if a[0] == name]
        code = judge(line, own, kilometres[name])
        codes.add(code)
        assert found[name]["code"] == code and found[name]["valid"] == (code is None), name
        assert found[name]["n_points"] == len(line) and found[name]["n_anchors"] == len(own)
        if code == "anchor_off_line":
            first = next(a for a in sorted(own, key=lambda a: (a[1], a[2])) if project(a[3], a[4], line)[0] > 350)
            assert found[name]["reason"] == f"Stop '{first[2]}' is too far from polyline ({project(first[3], first[4], line)[0]:.1f}m > 350m)"
        elif code is None:
            whole, most = sum(metres(*p, *q) for p, q in zip(line, line[1:])) / 1000, max(project(a[3], a[4], line)[0] for a in own)
            assert found[name]["reason"] == f"Validation PASS ({len(own)} anchors, {len(line)} points, {whole:.2f}km, max_stop_dist {most:.1f}m)"
    assert codes == {None, "too_few_points", "too_few_anchors", "anchor_off_line", "progress_not_monotone", "length_out_of_range"}


def test_reasons_of_each_rule(spark):
    line = [("a", k, 16.0 + k / 1000, 108.0) for k in range(20)]
    stops = lambda *ks: [("a", i, f"s{k}", 16.0 + k / 1000, 108.0) for i, k in enumerate(ks)]

    def reason(points, anchors, km=None):
        return geometry.validated(spark.createDataFrame(points, POINTS), spark.createDataFrame(anchors, ANCHORS), "line", spark.createDataFrame([("a", km)], "line string, kilometres double")).first()["reason"]

    assert reason(line[:14], stops(0, 1, 2, 3, 4)) == "Candidate polyline is missing or too short (< 15 points)"
    assert reason([], stops(0, 1, 2, 3, 4)) == "Candidate polyline is missing or too short (< 15 points)"
    assert reason(line, stops(0, 1, 2, 3)) == "Not enough verified anchors (4 < 5 minimum)"
    assert reason(line, stops(0, 5, 3, 8, 12)) == "Stop order non-monotonic along polyline path (prog 0.263 -> 0.158)"
    assert reason(line, stops(0, 5, 5, 8, 12), 50.0) == "Total length 2.11km deviates from expected 50.0km"
    assert reason(line, stops(0, 5, 5, 8, 12), 2.0).startswith("Validation PASS (5 anchors, 20 points, 2.11km")
    assert geometry.validated(spark.createDataFrame([], POINTS), spark.createDataFrame([], ANCHORS)).count() == 0


@pytest.mark.parametrize("greatest", [0.05, 3.0])
def test_growing_rings_find_the_nearest_segment(spark, greatest):
    r = random.Random(2)
    line = [(16 + r.uniform(0, 1), 108 + r.uniform(0, 1)) for _ in range(40)] + [(16.5, 108.5)] * 2
    anchors = [(16.5 + r.uniform(-greatest, greatest), 108.5 + r.uniform(-greatest, greatest)) for _ in range(60)] + [(75.0, 108.0), (-70.0, 20.0)]
    parts = spatial.segments(spark.createDataFrame([("a", k, *p) for k, p in enumerate(line)], POINTS), "line", "at")
    found = {x["anchor"]: x for x in spatial.onto_line(spark.createDataFrame([("a", k, *p) for k, p in enumerate(anchors)], "line string, anchor int, a_lat double, a_lng double"), parts, "line", "anchor").collect()}
    assert len(found) == len(anchors)
    for k, p in enumerate(anchors):
        off, segment, progress = project(*p, line)
        assert (found[k]["metres_off"], found[k]["progress"]) == (pytest.approx(off), pytest.approx(progress))
        assert abs(found[k]["segment"] - segment) <= 1  # two segments share a vertex, and rounding decides


def test_choice_between_stored_and_fetched_lines(spark):
    good = lambda name: [(name, k, 16.0 + k / 1000, 108.0) for k in range(20)]
    away = lambda name: [(name, k, 17.0 + k / 1000, 108.0) for k in range(20)]
    stops = [(n, k, f"s{k}", 16.0 + 3 * k / 1000, 108.0) for n in "abcde" for k in range(6)] + [("f", k, "s", 16.0, 108.0) for k in range(4)]
    existing, fetched = good("a") + good("b") + away("c") + away("d"), away("a") + good("b") + good("c") + away("d") + good("f")
    verified = spark.createDataFrame([("a",), ("c",), ("d",), ("f",)], "line string")
    decisions, points = geometry.chosen(spark.createDataFrame(existing, POINTS), verified, spark.createDataFrame(fetched, POINTS), spark.createDataFrame(stops, ANCHORS))
    found = {r["line"]: (r["source"], r["verified"], r["n_points"]) for r in decisions.collect()}
    assert found == {"a": ("stored", True, 20), "b": ("fetched", True, 20), "c": ("fetched", True, 20), "d": ("unresolved", False, 0), "e": ("unresolved", False, 0), "f": ("unresolved", False, 0)}
    why = {r["line"]: r["reason"] for r in decisions.collect()}
    assert why["f"] == "Insufficient anchors (4 < 5 minimum)" and "too far" in why["d"] and "missing" in why["e"]
    assert sorted(tuple(r) for r in points.collect()) == sorted(good("a") + good("b") + good("c"))
