"""A catalog after promotion: stops, shapes, provenance and the compact summary."""

from waymark.plans import rebuild


def test_rebuild(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    directions = [("7", "outbound"), ("7", "inbound"), ("8", "outbound"), ("8", "inbound")]
    listed = [(r, d, k, f"s{k}", "Lê Lợi") for r, d in directions for k in range(6)]
    place = lambda k: (16.0 + 3 * k / 1000, 108.0, "osm", f"n{k}", "x", "node")
    resolutions = [(r, d, k, "verified" if k < 5 else "needs_review", "high", "name_exact", *place(k)) for r, d in directions for k in range(6)]
    evaluations = [("7", "outbound", True, [], "Validation PASS (a)"), ("7", "inbound", True, None, None), ("8", "outbound", False, ["too few", "no source"], None), ("8", "inbound", None, [], None)]
    line = lambda r, d, y, n=20: [(r, d, k, y + k / 1000, 108.0) for k in range(n)]
    shape = "route string, direction string, at int, lat double, lng double"
    existing = line("7", "outbound", 16.0) + line("7", "inbound", 17.0) + line("8", "outbound", 16.0)
    fetched = line("7", "outbound", 16.5) + line("7", "inbound", 16.0, 25) + line("8", "outbound", 16.0)
    out = rebuild.rebuilt(
        table([("7", "A"), ("8", "B"), ("9", "C")], "route string, name string"),
        table(listed, "route string, direction string, ordinal int, name string, street string"),
        table(resolutions, "route string, direction string, ordinal int, status string, confidence string, method string, lat double, lng double, source string, node_id string, display_name string, node_type string"),
        table(evaluations, "route string, direction string, is_promoted boolean, reasons array<string>, validation string"),
        table(existing, shape), table([("7", "outbound"), ("7", "inbound"), ("8", "outbound")], "route string, direction string"), table(fetched, shape),
        table([("7", "b"), ("7", "a"), ("7", "b"), ("7", None)], "route string, street string"),
    )
    stops = out.stops.collect()
    assert len(stops) == 24
    last = [s for s in stops if s["ordinal"] == 5]
    assert all((s["status"], s["method"], s["confidence"], s["lat"], s["node_id"]) == ("unresolved", "unresolved", "unresolved", None, None) and s["name"] == "s5" for s in last)
    assert all(s["status"] == "verified" and s["lat"] == 16.0 + 3 * s["ordinal"] / 1000 for s in stops if s["ordinal"] < 5)
    # the stored line stays where it is valid, the fetched one comes where it isn't, and directions that aren't promoted have none
    points = [tuple(r) for r in out.points.collect()]
    assert sorted(points) == sorted(line("7", "outbound", 16.0) + line("7", "inbound", 16.0, 25))
    told = {(r["route"], r["direction"]): (r["source"], r["n_points"], r["verified"], r["validation"], r["reason"]) for r in out.provenance.collect()}
    assert told == {
        ("7", "outbound"): ("osm_osrm_verified", 20, True, "Validation PASS (a)", None), ("7", "inbound"): ("osm_osrm_verified", 25, True, "Validation PASS", None),
        ("8", "outbound"): ("unresolved", 0, False, None, "too few; no source"), ("8", "inbound"): ("unresolved", 0, False, None, "Data ceiling constraint"),
    }
    short = {r["route"]: (r["name"], r["outbound_stops"], r["inbound_stops"], r["outbound_geometry"], r["inbound_geometry"], r["streets"]) for r in out.summary.collect()}
    assert short == {"7": ("A", 6, 6, True, True, ["a", "b"]), "8": ("B", 6, 6, False, False, []), "9": ("C", 0, 0, False, False, [])}
