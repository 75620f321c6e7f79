import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from waymark.operators import catalog, differences, enrichment, identity, intervals, quality, resolution, sequences


def test_resolve_reports_ambiguity(spark):
    tokens = spark.createDataFrame([("R1",), ("17",), ("16",), ("x",)], "token string")
    ids = spark.createDataFrame([("R1", "R1"), ("09", "09")], "code string, id string")
    former = spark.createDataFrame([("17", "09"), ("16", "13"), ("16", "14"), (None, "13")], "code string, id string")
    found = {r["token"]: (r["via"], r["n_candidates"], r["id"], r["status"]) for r in identity.resolve(tokens, [("id", ids), ("former_code", former)]).collect()}
    assert found == {"R1": ("id", 1, "R1", "resolved"), "17": ("former_code", 1, "09", "resolved"), "16": ("former_code", 2, None, "ambiguous"), "x": (None, 0, None, "not_found")}


def test_successors(spark):
    links = [("C1", "C2"), ("C2", "C1"), ("B1", "MISSING"), ("V1", "V2"), ("V2", None)] + [(f"L{i}", f"L{i + 1}") for i in range(20)]
    table = spark.createDataFrame(links, "id string, next string")
    found = {r["start"]: (r["last"], r["hops"], r["status"]) for r in identity.successors(table.select("id"), table).collect()}
    assert found["C1"] == ("C2", 1, "cycle_detected") and found["B1"] == ("MISSING", 1, "broken_successor_reference") and found["V1"] == ("V2", 1, "resolved")
    assert found["L0"] == ("L10", 10, "max_hops_exceeded") and len(found) == len(links)
    assert [r["id"] for r in identity.broken_references(table).orderBy("id").collect()] == ["B1", "L19"]


def test_first_ordered_pair_is_brute_force(spark):
    r = random.Random(3)
    rows = [(k, i, r.choice("odx")) for k in range(40) for i in range(r.randint(0, 9))]
    found = {(x["k"], x["first_at"], x["second_at"]) for x in sequences.first_ordered_pair(spark.createDataFrame(rows, "k int, at int, what string"), ["k"], "at", F.col("what") == "o", F.col("what") == "d").collect()}
    expected = set()
    for k, own in itertools.groupby(rows, key=lambda x: x[0]):
        own = list(own)
        pairs = [(a[1], b[1]) for a in own for b in own if a[2] == "o" and b[2] == "d" and a[1] < b[1]]
        if pairs:
            expected.add((k, *min(pairs)))
    assert found == expected


def test_monotone_and_inversions(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (2, 1, 1), (2, 2, None), (3, 1, 1), (3, 2, 4)], "k int, at int, v int")
    assert {r["k"]: r["is_monotone"] for r in sequences.monotone(rows, ["k"], "at", F.col("v")).collect()} == {1: False, 2: False, 3: True}
    assert [(r["k"], r["at"]) for r in sequences.inversions(rows, ["k"], "at", "v", 1.0).collect()] == [(1, 2)]


def test_gap_clusters(spark):
    rows = spark.createDataFrame([(1, x) for x in (0.0, 5.0, 18.0, 30.0, 30.0)], "k int, u double")
    assert sorted((r["u"], r["cluster"]) for r in sequences.gap_clusters(rows, ["k"], F.col("u"), 12.0).collect()) == [(0.0, 0), (5.0, 0), (18.0, 1), (30.0, 1), (30.0, 1)]


def test_gap_clusters_in_buckets(spark):
    r = random.Random(23)
    rows = spark.createDataFrame([(r.choice([1, 2, None]), float(r.randint(0, 900))) for _ in range(200)], "k int, u double")
    whole = sequences.gap_clusters(rows, ["k"], F.col("u"), 12.0)
    cut = sequences.gap_clusters(rows, ["k"], F.col("u"), 12.0, F.floor(F.col("u") / 50))
    assert sorted(map(repr, map(tuple, whole.collect()))) == sorted(map(repr, map(tuple, cut.collect())))


def score_of(name, label):
    if label == name:
        return 100
    if min(len(label), len(name)) >= 6 and (label in name or name in label):
        return 85
    own, other = ({w for w in x.split() if w not in sequences.STOP_WORDS} for x in (name, label))
    return int(len(own & other) / max(len(own), 1) * 80)


def greedy(names, labels, terminals=frozenset()):
    found, used, at = [], set(), 0
    for i, name in enumerate(names):
        if i in terminals:
            found.append((i, None, 100))
            continue
        best, points = -1, 0
        for j in range(max(0, at - sequences.BACK), min(len(labels), at + sequences.AHEAD)):
            if j not in used and (s := score_of(name, labels[j])) > points:
                best, points = j, s
        if points >= sequences.LEAST_SCORE:
            used.add(best)
            found.append((i, best, points))
            at = max(at, best)
    return found


def test_greedy_alignment_equals_a_loop(spark):
    r = random.Random(9)
    words = ["số", "12", "lê", "duẩn", "hùng", "vương", "bến", "xe", "trạm", "chợ"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 4)))
    groups = {0: (["lê duẩn 1", "lê duẩn", "hùng vương"], ["lê duẩn", "hùng vương (trạm)", "xyz"], {0}), 1: (["a"], [], set()), 2: (["bến xe", ""], ["xe", ""], set())}
    for g in range(3, 60):
        names = [text() for _ in range(r.randint(1, 25))]
        labels = [n if r.random() < 0.5 else text() for n in names if r.random() < 0.8] + [text() for _ in range(r.randint(0, 6))]
        groups[g] = (names, labels, {i for i in range(len(names)) if r.random() < 0.1})
    n = spark.createDataFrame([(g, 10 * i, t, i in known) for g, (names, _, known) in groups.items() for i, t in enumerate(names)], "g int, at int, text string, terminal boolean")
    k = spark.createDataFrame([(g, 10 * i, t) for g, (_, labels, _) in groups.items() for i, t in enumerate(labels)], "g int, at int, text string")
    rows = sequences.align_groups(n, k, ["g"])
    got = sorted(((x["g"], x["name_at"], x["label_at"], x["score"]) for x in rows.collect()), key=repr)
    assert got == sorted(((g, 10 * i, None if j is None else 10 * j, s) for g, group in groups.items() for i, j, s in greedy(*group)), key=repr)
    assert not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().executedPlan().toString())


def test_alignment_report(spark):
    names = spark.createDataFrame([("r", i, t) for i, t in enumerate(["bến xe", "lê duẩn", "hùng vương", "cầu rồng"])], "route string, at int, text string").withColumn("terminal", F.col("at") == 0).withColumn("position", F.when(F.col("at") == 0, F.lit(410.0)))
    labels = spark.createDataFrame([("r", 0, "lê duẩn", 500.0), ("r", 1, "hùng vương", 430.0), ("r", 2, "phan chu trinh", 600.0)], "route string, at int, text string, position double")
    found = sequences.align_groups(names, labels, ["route"])
    assert sorted((r["name_at"], r["label_at"], r["score"]) for r in found.collect()) == [(0, None, 100), (1, 0, 100), (2, 1, 100)]
    r = sequences.alignment_report(names, labels, found, ["route"]).first()
    assert (r["n_names"], r["n_labels"], r["n_aligned"], r["rate"], r["inversions"], r["is_monotone"], r["unmatched_names"], r["unmatched_labels"]) == (4, 3, 3, 75.0, 1, False, [3], [2])


def test_labels_of_rays(spark):
    items = spark.createDataFrame([("r", 500.0, 100.0, "Lê "), ("r", 505.0, 100.0, "Duẩn"), ("r", 560.0, 100.0, "12"), ("r", 700.0, 300.0, "04 Chợ"), ("r", 710.0, 299.0, " Hàn"), ("r", 300.0, 100.0, "left")], "route string, left double, top double, text string")
    found = sorted((r["side"], r["label"], r["mean_left"]) for r in sequences.ray_labels(items, ["route"]).collect())
    assert found == [("lower", "Chợ Hàn", 705.0), ("upper", "Lê Duẩn", 502.5)]


def test_ends_of_sequences(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 5)], "k int, at int")
    assert sorted((r["k"], r["at"], r["is_first"], r["is_last"]) for r in sequences.with_ends(rows, ["k"], "at").collect()) == [(1, 0, True, False), (1, 1, False, False), (1, 2, False, True), (2, 5, True, True)]


def test_resolution_is_brute_force(spark):
    r = random.Random(5)
    names = [" ".join(r.choice(["cho", "han", "benh", "vien", "12", "le", "duan", "hung"]) for _ in range(r.randint(1, 4))) for _ in range(60)] + [""]
    places = spark.createDataFrame(list(enumerate(names[:30] + ["", names[0]])), "place_id int, place string")
    nodes = spark.createDataFrame(list(enumerate(names[20:] + [names[0]] * 3)), "node_id int, node string")
    score = resolution.name_score(F.col("place"), F.col("node"))
    brute = places.crossJoin(nodes).where("length(place) > 0 and length(node) > 0").withColumn("score", score).where("score is not null")
    pairs = sorted({(x["place"], x["node"], x["score"]) for x in brute.collect()})
    assert sorted((x["place"], x["node"], x["score"]) for x in resolution.candidates(places, nodes).collect()) == pairs
    expected = {}
    for x in brute.collect():
        expected.setdefault(x["place_id"], []).append((x["score"], x["node_id"]))
    best = {k: (max(v)[0], sorted(n for s, n in v if s == max(v)[0])) for k, v in expected.items()}
    got = {x["place_id"]: (x["score"], x["n_best"], x["node_id"], x["status"]) for x in resolution.decided(places, nodes).collect()}
    assert got == {k: (s, len(n), n[0], "verified" if len(n) == 1 else "needs_review") for k, (s, n) in best.items()}


def resolved_by_loops(place, nodes):
    """The rules of entity resolution in plain Python, for one (name, street)."""
    tidy = lambda t: re.sub(r"\s+", " ", re.sub(r"[,.\-/()–—:;\n\r]", " ", (t or "").lower().strip())).strip()
    name, street = tidy(place[1]), tidy(place[2])
    if "nam phước" in name and ("bến xe" in name or "tt" in name) or "cửa đại" in street and name not in resolution.BEACH_NAMES or "463 phan bội châu" in name:
        return ("unresolved", None, None)
    number = re.search(resolution.HOUSE_NUMBER, name)
    number = number[1].replace(" ", "") if number else None
    across = any(x in name for x in resolution.ACROSS) and "tường rào" not in name
    wanted = []
    if number and street:
        wanted = [f"đối diện {number} {street}", f"đ d {number} {street}", f"đối diện {number}"] if across else [f"{number} {street}", f"số nhà {number} {street}"]
    wanted.append(name)
    if street and street not in name:
        wanted.append(f"{name} {street}")
    wanted = [tidy(w) for w in wanted]
    digits = lambda t: [int(re.sub("[a-z]", "", x)) for x in re.findall(r"\b\d+[a-z]?\b", t)]
    hits = []
    for node in nodes:
        own = tidy(node[1])
        for t in wanted if own else []:
            if t == own:
                hits.append((node, 1.0, "exact"))
            elif min(len(t), len(own)) > 6 and (t.startswith(own) or own.startswith(t)):
                hits.append((node, 0.95, "prefix"))
            elif min(len(t), len(own)) > 8 and (t in own or own in t) and not (digits(t) and digits(own) and digits(t)[0] != digits(own)[0]):
                hits.append((node, 0.9, "substring"))
            else:
                continue
            break
    words = [w for w in street.split() if len(w) > 2]
    text = lambda node: tidy(node[1] + " " + (node[2] or ""))
    if not hits:
        return ("unresolved", None, None)
    if len(hits) == 1:
        node, score, how = hits[0]
        fine = score == 1.0 or not words or any(w in text(node) for w in words)
        return ("verified", str(node[0]), f"name_{how}") if fine else ("needs_review", None, None)
    same = [h for h in hits if number and (m := re.search(r"\b(\d+[a-z]?)\b", tidy(h[0][1]))) and m[1] == number]
    if len(same) == 1:
        return ("verified", str(same[0][0][0]), f"number_{same[0][2]}")
    first = hits[0][0]
    if all(abs(h[0][3] - first[3]) < 0.002 and abs(h[0][4] - first[4]) < 0.002 for h in hits):
        return ("verified", str(max(hits, key=lambda h: h[1])[0][0]), "twin_corridor")
    full = [h for h in hits if words and all(w in text(h[0]) for w in words)]
    if len(full) == 1:
        return ("verified", str(full[0][0][0]), "street")
    return ("needs_review", None, None)


def test_entity_resolution_is_brute_force(spark):
    r = random.Random(17)
    streets = ["Lê Duẩn", "Hùng Vương", "Cửa Đại", "", None]
    stems = ["Số nhà {} Lê Duẩn", "Đối diện {} Hùng Vương", "{} Hùng Vương", "Chợ Hàn", "Bệnh viện Đà Nẵng", "Bệnh viện", "Bến xe Nam Phước", "Công viên 29/3", "463 Phan Bội Châu", ""]
    make = lambda: r.choice(stems).format(r.choice([5, 12, 63, "12a"]))
    places = [(i, make(), r.choice(streets)) for i in range(150)]
    nodes = [(i, make() + r.choice(["", "", " (trạm)", ", Đà Nẵng"]), r.choice(streets), 16.0 + r.choice([0, 0.001, 0.05]), 108.0 + r.choice([0, 0.001, 0.05]), i) for i in range(40)]
    p, n = spark.createDataFrame(places, "place_id int, name string, street string"), spark.createDataFrame(nodes, "node_id int, name string, description string, lat double, lng double, ordinal int")
    found = {x["place_id"]: (x["status"], x["node_id"], x["method"]) for x in resolution.resolve(p, n).collect()}
    assert found == {x[0]: resolved_by_loops(x, nodes) for x in places} and len({v[2] for v in found.values()}) >= 6
    marked = resolution.resolve(p, n, [(F.col("place").contains("chợ hàn"), "way/1")]).where("method = 'landmark'").collect()
    assert {x["place_id"] for x in marked} == {x[0] for x in places if "Chợ Hàn" in x[1]} and {x["node_id"] for x in marked} == {"way/1"}


def test_next_and_overlay_are_brute_force(spark):
    r = random.Random(19)
    rows = [(r.randint(0, 3), r.randint(0, 500), r.choice("tvv")) for _ in range(400)]
    found = intervals.next_at(spark.createDataFrame(rows, "k int, at int, what string"), ["k"], "at", F.col("what") == "t", F.floor(F.col("at") / 50))
    expected = [(k, at, what, min((b for a, b, w in rows if a == k and w == "t" and b >= at), default=None)) for k, at, what in rows]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    windows = [(r.randint(0, 3), b := r.randint(0, 500), b + r.choice([-1, 0, 30, 120])) for _ in range(60)]
    got = intervals.overlay(spark.createDataFrame(rows, "k int, at int, what string"), spark.createDataFrame(windows, "k int, b int, e int"), ["k"], "at", "b", "e", 40.0)
    brute = [(k, at, x, *w) for k, at, x in rows for w in ([w for w in windows if w[0] == k and w[1] <= at <= w[2]] or [(None, None, None)])]
    assert sorted(map(repr, map(tuple, got.select("k", "at", "what", "w_k", "w_b", "w_e").collect()))) == sorted(map(repr, brute))


def fare(spark, kind, flat=None, single=None, low=None, high=None, tiers=None):
    t = F.from_json(F.lit(tiers), "array<struct<price:double,distanceMaxKm:double>>") if tiers else F.lit(None).cast("array<struct<price:double,distanceMaxKm:double>>")
    values = [F.lit(x).cast("long") for x in (flat, single, low, high)]
    return spark.range(1).select(quality.fare_ok(F.lit(kind), *values, t).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "fields, good",
    [
        ({"kind": "flat", "flat": 8000}, True),
        ({"kind": "flat", "single": 8000}, True),
        ({"kind": "flat"}, False),
        ({"kind": "flat", "flat": -1}, False),
        ({"kind": "distance_tiered", "low": 8000, "high": 30000}, True),
        ({"kind": "distance_tiered", "low": 8000, "high": 30000, "single": 1}, False),
        ({"kind": "distance_tiered", "low": 8000, "high": 30000, "tiers": "[]"}, False),
        ({"kind": "distance_tiered", "low": 8000, "high": 30000, "tiers": "[null]"}, False),
        ({"kind": "distance_tiered", "low": 8000, "high": 30000, "tiers": '[{"price":8000},null]'}, False),
        ({"kind": "distance_tiered", "tiers": '[{"price":8000,"distanceMaxKm":10}]'}, True),
        ({"kind": "distance_tiered", "tiers": '[{"price":0}]'}, False),
        ({"kind": "distance_tiered", "tiers": '[{"price":5,"distanceMaxKm":-10}]'}, False),
        ({"kind": "other", "flat": 5}, False),
    ],
)
def test_fares(spark, fields, good):
    assert fare(spark, **fields) is good


def test_geometry_reasons(spark):
    lit = lambda x: F.lit(x).cast("double")
    reason = lambda *a: spark.range(1).select(quality.geometry_reason(*map(lit, a)).alias("x")).first()["x"]
    assert reason(15, 5, 350, 0.05, 1000, 1000) is None and reason(15, 5, 10, 0, 1000, None) is None
    assert [reason(14, 5, 0, 0, 1, 1), reason(15, 4, 0, 0, 1, 1), reason(15, 5, 351, 0, 1, 1), reason(15, 5, 0, 0.06, 1, 1), reason(15, 5, 0, 0, 19, 10)] == ["too_few_points", "too_few_anchors", "anchor_off_line", "progress_not_monotone", "length_out_of_range"]


def test_contract_drift_and_coverage(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, None, "a"), (3, 0, "b")], "k int, v int, g string")
    found = {r["k"]: (r["reasons"], r["eligible"]) for r in quality.with_contract(rows, [(F.col("v") > 0, "no value"), (F.col("k") < 3, "late")]).collect()}
    assert found == {1: ("", True), 2: ("no value", False), 3: ("no value; late", False)}
    other = spark.createDataFrame([(1, 5), (2, 1), (4, 1)], "k int, v int")
    assert {r["k"]: r["drift"] for r in quality.drift(rows, other, ["k"], ["v"]).collect()} == {2: "changed", 3: "only_stored", 4: "only_computed"}
    assert {r["g"]: (r["total"], r["with_value"], r["with_value_pct"]) for r in quality.coverage(rows, ["g"], {"with_value": F.col("v") > 0}).collect()} == {"a": (2, 1, 50.0), "b": (1, 0, 0.0)}


def test_catalog(spark):
    rows = spark.createDataFrame([(1, ["b", "a"], ["c"]), (2, ["a"], None)], "k int, x array<string>, y array<string>")
    assert {r["token"]: r["keys"] for r in catalog.inverted_index(rows, "k", F.col("x"), 1).collect()} == {"a": [1, 2], "b": [1]}
    assert catalog.inverted_index(spark.range(1000).select("id", F.array(F.lit("w")).alias("x")), "id", F.col("x"), 16).where("n > 200").count() == 0
    assert {r["token"]: (r["n"], r["first_key"], r["last_key"]) for r in catalog.token_counts(rows, "k", F.col("x")).collect()} == {"a": (2, 1, 2), "b": (1, 1, 1)}
    found = {r["k"]: (r["names"], r["n_names"], r["n_x"], r["n_y"], r["has_geometry"]) for r in catalog.compact(rows, "k", ["x", "y"], F.col("k") == 1).collect()}
    assert found == {1: (["a", "b", "c"], 3, 2, 1, True), 2: (["a"], 1, 1, 0, False)}
    names = catalog.directory(rows.select("k", F.explode("x").alias("n")), F.col("n"), "k").orderBy("id").collect()
    assert [(r["name"], r["id"], r["n"]) for r in names] == [("a", 1, 2), ("b", 2, 1)]
    many = catalog.directory(spark.range(5000).select("id", (F.col("id") * 7 % 1000).cast("string").alias("n")), F.col("n"), "id").orderBy("id").collect()
    assert [(r["id"], r["first_at"], r["name"], r["n"]) for r in many] == [(k + 1, k, str(k * 7 % 1000), 5) for k in range(1000)]
    assert catalog.directory(rows.limit(0).select("k", F.lit("x").alias("n")), F.col("n"), "k").count() == 0
    assert rows.select(catalog.ordered_union(F.col("x"), F.col("y"), F.col("x")).alias("u")).collect()[0]["u"] == ["b", "a", "c"]


def test_audit_of_references(spark):
    records = spark.createDataFrame([("A",), ("B",), ("B",), (None,), ("C",), ("D",)], "id string")
    links = {"superseded": spark.createDataFrame([("A", "B"), ("C", "X")], "id string, next string"), "merged": spark.createDataFrame([("B", "A"), ("C", "D"), ("D", "C")], "id string, next string")}
    found = sorted(map(tuple, identity.audit(records, links).collect()), key=repr)
    # A is replaced by B, which is merged into A: no cycle of one kind
    assert found == sorted([("missing_id", None, None), ("duplicate_id", None, "B"), ("broken_reference", "superseded", "C"), ("reference_cycle", "merged", "C"), ("reference_cycle", "merged", "D")], key=repr)
    codes = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 1)], "code string, id int")
    assert [tuple(r) for r in identity.collisions(codes).collect()] == [("x", 2, 1, 2)] and identity.owners(codes).count() == 2


def test_reports(spark):
    rows = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("c", 3, None)], "id string, at int, ready boolean")
    found = {r["class"]: (r["n"], r["pct"], r["ids"]) for r in quality.coverage_lists(rows, "id", [(F.col("ready"), "ready"), (F.col("at") == 3, "late")], "at").collect()}
    assert found == {"ready": (1, 33.33, ["a"]), "late": (1, 33.33, ["c"]), "other": (1, 33.33, ["b"])}
    dates = spark.createDataFrame([("a", "2024-01-01", None), ("b", "soon", ""), ("c", None, "")], "route_id string, effective_from string, effective_to string")
    assert {r["route_id"]: (r["is_bounded"], r["valid_dates"]) for r in quality.temporal_audit(dates).collect()} == {"a": (True, True), "b": (True, False), "c": (False, True)}
    quality.checked(rows.agg(F.count("*").alias("n")), rows.agg(F.count("*").alias("n")), ["n"])
    with pytest.raises(ValueError, match="n"):
        quality.checked(rows.agg(F.count("*").alias("n")), rows.limit(1).agg(F.count("*").alias("n")), ["n"])


@pytest.mark.parametrize(
    "args, reason",
    [
        (("flat", 8000, None, None, None, None), None),
        (("flat", None, 8000, None, None, None), None),
        (("flat", -1, 8000, None, None, None), quality.FLAT_PRICE),
        (("distance_tiered", None, None, 0, 5, None), quality.LOW_PRICE),
        (("distance_tiered", None, None, 5, -1, None), quality.HIGH_PRICE),
        (("distance_tiered", None, None, 5, 4, None), quality.REVERSED_PRICES),
        (("distance_tiered", None, None, 5, 6, "[]"), quality.EMPTY_TIERS),
        (("distance_tiered", None, None, 5, 6, "[null]"), quality.NULL_TIER),
        (("distance_tiered", None, None, 5, 6, '[{"price":1},{"price":0}]'), quality.TIER_PRICE),
        (("distance_tiered", None, None, 5, 6, '[{"price":1,"distanceMaxKm":0}]'), quality.TIER_KM),
        (("distance_tiered", None, None, 5, None, None), quality.NO_PRICES),
        (("distance_tiered", None, 1, 5, 6, None), quality.SINGLE_TICKET),
        (("distance_tiered", None, None, None, None, '[{"price":1}]'), None),
        ((None, None, None, None, None, None), quality.UNKNOWN_FARE + "None)"),
    ],
)
def test_fare_reasons(spark, args, reason):
    kind, *values, tiers = args
    t = F.from_json(F.lit(tiers), "array<struct<price:double,distanceMaxKm:double>>") if tiers else F.lit(None).cast("array<struct<price:double,distanceMaxKm:double>>")
    found = quality.fare_reason(F.lit(kind).cast("string"), *[F.lit(v).cast("long") for v in values], t)
    assert spark.range(1).select(found.alias("x")).first()["x"] == reason


def test_readiness(spark):
    routes = spark.createDataFrame([("1", "active", "http://x", "d", "verified", None), ("2", "retired", None, None, None, "no fare")], "route_id string, status string, source_url string, last_verified_at string, verification_status string, fare_reason string")
    side = lambda r, d, rows: [(r, d, i, o, 16.0, 108.0, s) for i, (o, s) in enumerate(rows)]
    stops = spark.createDataFrame(side("1", "outbound", [(1, "verified"), (5, "x"), (2, "verified")]) + side("1", "inbound", [(3, "verified"), (3, "verified")]), "route_id string, direction string, pos int, ord int, lat double, lng double, status string")
    points = spark.createDataFrame([("1", "outbound", 16.0, 108.0), ("1", "outbound", 16.1, 108.0), ("1", "inbound", 16.0, 999.0), ("1", "inbound", 16.0, 108.0)], "route_id string, direction string, lat double, lng double")
    proofs = spark.createDataFrame([("1", "outbound", True), ("1", "inbound", True)], "route_id string, direction string, verified boolean")
    sides = quality.direction_quality(routes, stops, points, proofs).cache()
    found = {(r["route_id"], r["direction"]): (r["eligible"], r["reason"]) for r in sides.collect()}
    assert found[("1", "outbound")] == (True, None)
    assert found[("1", "inbound")] == (False, "Thứ tự trạm dừng verified không tăng đơn điệu (order 3 >= 3); " + quality.BAD_POINT)
    assert found[("2", "outbound")] == (False, "; ".join(["Tuyến không hoạt động (status=retired)", quality.NO_SOURCE, "Chỉ có 0/0 trạm verified (yêu cầu tối thiểu 2 trạm có tọa độ hợp lệ)", quality.FEW_POINTS, "no fare"]))
    whole = {r["route_id"]: (r["planning_ready"], r["reasons"]) for r in quality.route_quality(sides).collect()}
    assert whole["1"] == (False, ["Chiều về chưa sẵn sàng: " + found[("1", "inbound")][1]]) and whole["2"][0] is False and len(whole["2"][1]) == 5


def test_enrichment(spark):
    routes = spark.createDataFrame([("1", "active", "http://old", None, None, None, None, None, ["9"], ["a"], True), ("2", "merged", None, None, None, "d", None, "1", None, None, True)], "route_id string, status string, source_url string, effective_from string, effective_to string, last_verified_at string, superseded_by string, merged_into string, former_codes array<string>, aliases array<string>, planning_ready boolean")
    entries = spark.createDataFrame([("1", "http://new", None, None, None, None, None, ["9", "8"], "verified")], "route_id string, source_url string, effective_from string, effective_to string, last_verified_at string, superseded_by string, merged_into string, former_codes array<string>, verification_status string")
    found = {r["route_id"]: r for r in enrichment.reconciled(routes, entries, "route_id", "today").collect()}
    assert (found["1"]["source_url"], found["1"]["former_codes"], found["1"]["aliases"], found["1"]["planning_ready"], found["1"]["last_verified_at"]) == ("http://new", ["9", "8"], ["a", "9", "8"], True, "today")
    assert (found["2"]["planning_ready"], found["2"]["verification_status"], found["2"]["last_verified_at"]) == (False, "unverified", "d")
    old = spark.createDataFrame([("a", "out", [1], None, True), ("b", "out", [1], "too_few_points", True), ("c", "out", [1], None, False)], "route string, direction string, points array<int>, reason string, was_verified boolean")
    new = spark.createDataFrame([("a", "out", [2], None), ("b", "out", [2], None), ("c", "out", [2], "anchor_off_line")], "route string, direction string, points array<int>, reason string")
    shapes = {r["route"]: (r["points"], r["source"], r["verified"], r["reason"]) for r in enrichment.chosen_shapes(old, new, ["route", "direction"]).collect()}
    assert shapes == {"a": ([1], "stored", True, None), "b": ([2], "fetched", True, None), "c": (None, "unresolved", False, "anchor_off_line")}
    stops = spark.createDataFrame([("a", "x", 1.0, 1.0), ("a", "x", None, 1.0), ("b", "x", 1.0, 1.0)], "route string, status string, lat double, lng double")
    promoted = spark.createDataFrame([("a", True), ("b", False)], "route string, is_promoted boolean")
    s, g = enrichment.with_promoted(stops, spark.createDataFrame([("a", [1], True), ("b", [1], True)], "route string, points array<int>, verified boolean"), promoted, "route")
    assert sorted(map(repr, map(tuple, s.collect()))) == sorted(map(repr, [("a", "verified", 1.0, 1.0), ("a", "x", None, 1.0), ("b", "x", 1.0, 1.0)]))
    assert {r["route"]: (r["points"], r["verified"]) for r in g.collect()} == {"a": ([1], True), "b": (None, False)}


def test_successors_take_a_join_a_hop_and_stop_early(spark):
    chain = [(i, i + 1) for i in range(3)] + [(3, None), (10, 11), (11, 10), (20, 99)] + [(i, i + 1) for i in range(30, 60)]
    links = spark.createDataFrame(chain, "id int, next int")
    rows = identity.successors(links.select("id").where("id IN (0, 10, 20, 30)"), links)
    assert {r["start"]: (r["last"], r["hops"], r["status"]) for r in rows.collect()} == {0: (3, 3, "resolved"), 10: (11, 1, "cycle_detected"), 20: (99, 1, "broken_successor_reference"), 30: (40, 10, "max_hops_exceeded")}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 3
    short = identity.successors(links.select("id").where("id = 0"), links)
    assert short._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    assert identity.successors(links.select("id").limit(0), links).count() == 0


def brute_differences(a, b, ignored, slack, path="", name=""):
    """Of dicts (structs), lists and plain values; a Map is compared by keys that are there."""
    if name in ignored:
        return []
    step = lambda p, s: f"{p}.{s}" if p else s
    if a is None or b is None:
        return [] if a is None and b is None else [path]
    if isinstance(a, dict):
        out = []
        for k in sorted(a.keys() | b.keys()) if isinstance(a, Map) else a:
            if (k in a) != (k in b):
                out.append(step(path, k))
            else:
                out += brute_differences(a[k], b[k], ignored, slack, step(path, k), name if isinstance(a, Map) else step(name, k))
        return out
    if isinstance(a, list):
        out = [step(path, "size")] if len(a) != len(b) else []
        for i, (x, y) in enumerate(zip(a, b)):
            out += brute_differences(x, y, ignored, slack, f"{path}[{i}]", name)
        return out
    if isinstance(a, float):
        return [] if abs(a - b) <= slack or a == b else [path]
    return [] if a == b else [path]


class Map(dict):
    pass


def plain(v):
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v


NESTED = "k int, v struct<at:string,n:struct<x:double,s:string>,l:array<struct<p:double,tags:array<string>>>,m:map<string,struct<y:double,at:string>>>"


def nested_value(r):
    number = lambda: r.choice([None, 1.0, 1.0, 1.004, 2.0])
    word = lambda: r.choice([None, "a", "a", "b"])
    maybe = lambda make: make() if r.random() < 0.85 else None
    item = lambda: maybe(lambda: {"p": number(), "tags": maybe(lambda: [word() for _ in range(r.randint(0, 2))])})
    return maybe(lambda: {"at": word(), "n": maybe(lambda: {"x": number(), "s": word()}), "l": maybe(lambda: [item() for _ in range(r.randint(0, 3))]), "m": maybe(lambda: Map({k: maybe(lambda: {"y": number(), "at": word()}) for k in "uvw" if r.random() < 0.6}))})


@pytest.mark.parametrize("ignored, slack", [((), 0.0), (("v.at", "v.m.at"), 0.01), (("v.l", "v.n.s"), 0.0)])
def test_nested_differences(spark, ignored, slack):
    r = random.Random(6)
    a, b = ([(k, nested_value(r)) for k in range(300)] for _ in range(2))
    a.append((None, nested_value(r)))
    b.append((900, None))
    found = differences.nested_drift(*[spark.createDataFrame([(k, plain(v)) for k, v in rows], NESTED) for rows in (a, b)], ["k"], ignored, slack)
    got = {x["k"]: (x["drift"], [d["path"] for d in x["differences"]]) for x in found.collect()}
    expected = {None: ("only_stored", []), 900: ("only_computed", [])}
    for (k, x), (_, y) in zip(a[:300], b[:300]):
        if paths := brute_differences(x, y, ignored, slack, "v", "v"):
            expected[k] = ("changed", paths)
    assert got == expected


def test_differences_of_other_types(spark):
    stored = spark.createDataFrame([(1, (1, "x", [1]), {"a": 1})], "k int, v struct<a:int,b:string,c:array<int>>, m map<string,int>")
    computed = spark.createDataFrame([(1, (1.0, 5, "z"), {"a": 2})], "k int, v struct<a:double,d:int,c:string>, m map<string,int>")
    got = differences.nested_drift(stored, computed, ["k"]).first()["differences"]
    assert [tuple(d) for d in got] == [("v.b", "x", None), ("v.c", "[1]", "z"), ("v.d", None, "5"), ("m.a", "1", "2")]
