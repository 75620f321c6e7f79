import pytest
from pyspark.sql import functions as F

from waymark.operators import journeys
from waymark.plans import planner

NETWORK = [
    ("R1", 0, 16.000, 108.000), ("R1", 1, 16.010, 108.010), ("R2", 0, 16.0105, 108.0105), ("R2", 1, 16.020, 108.020), ("R2", 2, 16.030, 108.030),
    ("R3", 0, 16.0305, 108.0305), ("R3", 1, 16.040, 108.040), ("R3", 2, 16.050, 108.050),
]
ENDS = (16.0001, 108.0001, 16.0499, 108.0499)


def network(spark, changed=None):
    rows = []
    for line, idx, lat, lng in NETWORK:
        row = {"route_id": line, "direction": "outbound", "idx": idx, "name": f"Stop {line}_{idx + 1}", "lat": lat, "lng": lng, "status": "verified", "ready": True, "usable": True}
        rows.append(row | (changed(line, idx) if changed else {}))
    return spark.createDataFrame(rows, "route_id string, direction string, idx int, name string, lat double, lng double, status string, ready boolean, usable boolean")


def plan(spark, stops, ends=ENDS):
    asked = spark.createDataFrame([(1, *ends)], "query_id long, o_lat double, o_lng double, d_lat double, d_lng double")
    found, outcome = planner.plan(asked, stops)
    return found.orderBy("rank").collect(), outcome.first()["outcome"]


def test_two_transfers(spark):
    found, outcome = plan(spark, network(spark))
    best = found[0]
    assert outcome == "OK" and best["transfers"] == 2 and best["routes"] == ["R1_outbound", "R2_outbound", "R3_outbound"] and best["places"] == [0, 1, 0, 2, 0, 2]
    assert (best["minutes"], best["cost"], best["walk_metres"]) == (26, 52.0, 184.8)


def test_legs(spark):
    found = spark.createDataFrame([(["A", "B"], [0, 3, 1, 2]), (["A"], [0, 1])], "routes array<string>, places array<long>")
    rows = [[(x["role"], x["route"], x["board"], x["alight"]) for x in r["legs"]] for r in journeys.with_legs(found).collect()]
    assert rows[0] == [("origin", None, None, None), ("ride", "A", 0, 3), ("transfer", None, None, None), ("ride", "B", 1, 2), ("destination", None, None, None)]
    assert [x[0] for x in rows[1]] == ["origin", "ride", "destination"]
    assert spark.range(1).select(journeys.fare_summary(F.array(F.lit("8.000đ"), F.lit(None), F.lit("5.000đ")))).first()[0] == "8.000đ + 5.000đ"


def test_penalties_and_rides(spark):
    stops = network(spark)
    metrics = spark.createDataFrame([("R1_outbound", 8, 10), ("R2_outbound", 7, 10), ("R3_outbound", 1, 10)], "route string, verified int, total int")
    asked = spark.createDataFrame([(1, *ENDS, "home", "work")], "query_id long, o_lat double, o_lng double, d_lat double, d_lng double, o_label string, d_label string")
    found, _ = planner.plan(asked, stops, metrics=metrics)
    assert (found.first()["cost"], found.first()["penalty"]) == (59.5, 7.5)
    usable = planner.usable_stops(stops)
    lines = spark.createDataFrame([(f"R{k}_outbound", str(k), f"Line {k}", f"{k}.000đ") for k in (1, 2, 3)], "route string, number string, name string, fare string")
    shapes = spark.createDataFrame([("R2_outbound", [(16.0, 108.0), (16.0105, 108.0105), (16.02, 108.02), (16.03, 108.03), (16.5, 108.5)])], "route string, points array<struct<lat:double,lng:double>>")
    trip = journeys.materialised(found, asked, usable, lines, shapes).first()
    rides = trip["rides"]
    assert [(r["route"], r["board_name"], r["alight_name"], r["stops"], r["minutes"], r["fare"]) for r in rides] == [("R1_outbound", "Stop R1_1", "Stop R1_2", 1, 4, "1.000đ"), ("R2_outbound", "Stop R2_1", "Stop R2_3", 2, 4, "2.000đ"), ("R3_outbound", "Stop R3_1", "Stop R3_3", 2, 4, "3.000đ")]
    assert [len(r["shape"]) if r["shape"] else None for r in rides] == [None, 3, None] and trip["fare_text"] == "1.000đ + 2.000đ + 3.000đ"
    assert [(w["role"], w["from_label"], w["to_label"]) for w in trip["walks"]] == [("origin", "home", "Stop R1_1"), ("transfer", "Stop R1_2", "Stop R2_1"), ("transfer", "Stop R2_3", "Stop R3_1"), ("destination", "Stop R3_3", "work")]
    assert trip["walks"][1]["metres"] == 77 and trip["walks"][1]["summary"] == "Đi bộ ước tính ~77m (1 phút)"
    view = planner.view_planned(journeys.materialised(found, asked, usable, lines), asked).first()
    assert (view["route"], view["origin_name"], view["destination_name"], view["stops"], view["distance_km"], view["is_direct"]) == ("R1_outbound", "home", "work", 5, None, False)


def test_views_of_matches(spark):
    matches = spark.createDataFrame([(1, "a", "b", "R2", "outbound", 0, 2)], "query_id int, origin string, destination string, route string, direction string, first_at int, second_at int")
    lines = spark.createDataFrame([("R2", "2", "8.000đ", "Đang cập nhật", None, None, 7.5, "Fuso")], "route string, number string, fare string, frequency string, minutes int, average_km double, direction_km double, brand string")
    stops = network(spark).select(F.col("route_id").alias("route"), "direction", "idx", "name")
    view = planner.view_direct(matches, lines, stops).first()
    assert (view["boarding_stop"], view["alighting_stop"], view["between"], view["stops"], view["frequency_text"], view["distance_km"]) == ("Stop R2_1", "Stop R2_3", ["Stop R2_2"], 3, None, 7.5)
    planned = spark.createDataFrame([(1, "t"), (2, "t")], "query_id int, journey string")
    found = {(r["query_id"], r["source"]): r["only_planned"] for r in planner.alternatives(matches.select("query_id"), planned, ["query_id"]).collect()}
    assert found == {(1, "direct"): False, (1, "planner"): False, (2, "planner"): True}


def test_totals_of_rides(spark):
    rows = spark.createDataFrame([([(2, 1.24), (3, 2.0)],), ([(2, None)],), ([(0, 1.0)],), ([],)], "rides array<struct<stops:int,kilometres:double>>")
    assert [tuple(r["t"]) for r in rows.select(journeys.leg_totals(F.col("rides")).alias("t")).collect()] == [(5, 3.2), (2, None), (None, 1.0), (None, None)]
    scores = spark.createDataFrame([(2, 3), (None, 3), (1, 0), (1, None)], "v int, t int")
    assert [r["s"] for r in scores.select(journeys.confidence_score(F.col("v"), F.col("t")).alias("s")).collect()] == [0.67, 0.0, 1.0, 1.0]


def test_transfer_index(spark):
    edges = {(r["from_route"], r["from_idx"], r["to_route"], r["to_idx"], r["metres"]) for r in planner.transfer_index(planner.usable_stops(network(spark))).collect()}
    out = lambda a, i, b, j: (f"{a}_outbound", i, f"{b}_outbound", j, 77)
    assert edges == {out("R1", 1, "R2", 0), out("R2", 0, "R1", 1), out("R2", 2, "R3", 0), out("R3", 0, "R2", 2)}


@pytest.mark.parametrize(
    "changed",
    [
        lambda line, i: {"ready": line != "R2"},
        lambda line, i: {"status": "needs_review"} if (line, i) == ("R2", 0) else {},
    ],
)
def test_nothing_without_the_middle(spark, changed):
    assert plan(spark, network(spark, changed)) == ([], "NO_VIABLE_ROUTE")


def test_unusable_stops(spark):
    gone = lambda line, i: {"status": "unresolved", "lat": None, "lng": None} if (line, i) == ("R2", 0) else {"usable": line != "R3"}
    usable = planner.usable_stops(network(spark, gone)).collect()
    assert {(r["line"], r["idx"]) for r in usable} == {("R1", 0), ("R1", 1), ("R2", 1), ("R2", 2)}


def test_no_line_twice(spark):
    found = spark.createDataFrame([(["R1_outbound", "R2_outbound"],), (["R1_outbound", "R2_inbound", "R1_inbound"],)], "routes array<string>")
    assert [r["routes"] for r in planner.distinct_lines(found).collect()] == [["R1_outbound", "R2_outbound"]]


def test_outcomes(spark):
    cases = [(21.0285, 105.8542, 16.0, 108.0, "OUT_OF_SERVICE_AREA"), (None, 108.0, 16.0, 108.0, "INVALID_ENDPOINTS"), (95.0, 108.0, 16.0, 108.0, "INVALID_COORDINATES"), (16.0, 108.0, 16.0001, 108.0001, "SAME_LOCATION"), (15.5, 108.5, 16.0, 108.0, "NO_NEARBY_STOPS")]
    asked = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "query_id long, o_lat double, o_lng double, d_lat double, d_lng double")
    found, outcome = planner.plan(asked, network(spark), transfers=1)
    assert {r["query_id"]: r["outcome"] for r in outcome.collect()} == {i: c[4] for i, c in enumerate(cases)}
