import pytest
from pyspark.sql import functions as F

from waymark.functions import extract
from waymark.operators import enrichment


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fields(spark):
    text = lambda x: F.lit(x).cast("string")
    assert [tuple(one(spark, extract.distances(text(x)))) for x in ("5. Cự ly tuyến: 12,5 km", "Cự ly: 12,5 km, về 13 km", "b) Cự ly: 20km (đi 9,5 km, về 10 km, x 3 km)")] == [(12.5, None, None), (12.75, 12.5, 13.0), (20.0, 9.5, 10.0)]
    assert tuple(one(spark, extract.distances(text("Cự ly: dưới 10 km 8.000 đồng\nCự ly: 7 km")))) == (7.0, None, None)
    assert [one(spark, extract.distances(text(x))) for x in ("Cự ly di chuyển: 9 km", "Giá vé dưới 10 km: 8000", None)] == [None, None, None]
    assert [tuple(one(spark, extract.hours(text(x)))) for x in ("Thời gian hoạt động: từ 5h15 đến 18:30", "Thời gian mở tuyến: 5h15", None)] == [(315, 1110), (None, None), (None, None)]
    assert [tuple(one(spark, extract.headways(text(x)))) for x in ("Tần suất chạy xe: 30 phút, cao điểm 15 phút", "Giãn cách chạy xe: 20 phút/chuyến", "Thời gian hoạt động: 5h15-18h30 (25 phút/chuyến)", None)] == [(15, 30), (20, 20), (25, 25), (None, None)]
    assert tuple(one(spark, extract.terminals(text("2. Điểm đầu: Bến xe; x\nĐiểm cuối: Chợ Hàn")))) == ("Bến xe", "Chợ Hàn")
    assert tuple(one(spark, extract.paths(text("Chiều đi: A - B STT 1\n+ Chiều về: B - A 4. Giá vé")))) == ("A - B", "B - A")
    assert tuple(one(spark, extract.fares(text("Giá vé: 8.000 đồng\nưu tiên: 90.000 đồng, không ưu tiên: 200.000 đồng")))) == (8000, 90000, 200000)
    assert [one(spark, extract.house_number(text(x))) for x in ("Số 128 Lê Duẩn", "12A Hùng Vương", "Đối diện số 7", "Lê Duẩn", None)] == ["128", "12A", "7", "", ""]
    assert [one(spark, extract.opposite(text(x))) for x in ("Đối diện 12", "Số 12", None)] == [True, False, False]
    assert [one(spark, extract.without_badge(text(x))) for x in ("11 Chợ Hàn", "1204 Lê Lợi", "05 12Bến xe", "221 Nguyễn", "7 Lê Duẩn", "30 Hùng Vương", None)] == ["Chợ Hàn", "Lê Lợi", "Bến xe", "1 Nguyễn", "7 Lê Duẩn", "30 Hùng Vương", None]
    assert [one(spark, extract.last_part(text(x))) for x in ("A - B - C", "X -", "X - ", "chợ", None)] == ["C", "X -", "X - ", "chợ", ""]


def test_continued_paths(spark):
    text = lambda x: F.lit(x).cast("string")
    path = lambda x: tuple(one(spark, extract.paths(text(x))))
    assert path("Chiều đi: A - B - C\nD - E - F\nG\nChiều về: F\nE - D") == ("A - B - C D - E - F", "F E - D")
    assert path("CHIỀU ĐI: A - B\nC - Đ1 - E\n") == ("A - B C - Đ", "")
    assert path("Chiều đi: A - B\nSTT Tên") == ("A - B", "") and path("Chiều đi: A\n1. B") == ("A", "") and path("Chiều đi: A - B\nc - b) Cự ly: 7 km") == ("A - B c -", "")


def test_vehicles(spark):
    read = lambda x: tuple(one(spark, extract.vehicle(F.lit(x).cast("string"))))
    assert read("Nhãn hiệu: Thaco; Sức chứa: 40 chỗ") == ("Thaco", "40 chỗ", "40 chỗ")
    assert read("nhãn HIỆU:  Vin\nSức chứa: 68 chỗ (28 ngồi); xe điện") == ("Vin", "68 chỗ (28 ngồi)", "68 chỗ (28 ngồi)")
    assert read("Xe Điện mới") == ("Xe buýt điện", "", "Xe buýt điện") and read(" GAZelle Next") == ("GAZ", "", "Xe buýt") and read("Thaco 40 chỗ") == ("Chưa có dữ liệu", "", "Xe buýt")
    assert read(None) == read("  ") == ("Chưa có dữ liệu", "", "Phương tiện")
    assert [one(spark, extract.seats(F.lit(x).cast("string"))) for x in ("40 chỗ", "68 CHỖ (28)", "?", None)] == [40, 68, None, None]


@pytest.mark.parametrize("peak, off, after", [(None, 20, 10), (0, 20, 10), (15, 20, 5), (-5, 0, None), (None, None, None), (0, -1, None)])
def test_following_departures(spark, peak, off, after):
    assert one(spark, extract.following_departure(F.lit(1430), F.lit(peak).cast("int"), F.lit(off).cast("int"))) == after


@pytest.mark.parametrize("begin, end, proven, problem", [("2026-10-01", "2026-10-05", True, None), ("x", "2026-10-05", True, "invalid_date"), (None, "2026-10-05", True, "invalid_date"), ("2026-10-09", "2026-10-05", True, "reversed"), ("2026-10-01", "2026-10-05", None, "unproven"), ("2024-02-31", "2026-10-05", True, "invalid_date"), ("2024-02-29", "2024-02-29T24:00", True, "invalid_date"), ("2024-02-29", "2024-02-29T23:59:59+07:00", True, None), ("2024-02-29Tx", "2024-03-01", True, "invalid_date"), ("2023-02-29", "2024-03-01", True, "invalid_date")])
def test_override_problem(spark, begin, end, proven, problem):
    assert one(spark, extract.override_problem(F.lit(begin).cast("string"), F.lit(end).cast("string"), F.lit(proven).cast("boolean"))) == problem


def test_enrichment(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    entries = spark.createDataFrame([(1, "https://x", "2026", "verified")], "k int, source_url string, last_verified_at string, verification_status string")
    full = enrichment.with_provenance(rows, entries, "k")
    assert {r["k"]: r["verification_status"] for r in full.collect()} == {1: "verified", 2: "unverified"}
    assert [r["k"] for r in enrichment.unmatched(rows, entries, "k").collect()] == [2]
    assert {r["k"]: r["v"] for r in enrichment.materialised(full, F.col("verification_status") == "verified", ["v"]).collect()} == {1: "a", 2: None}
    evidence = spark.createDataFrame([(1, 5), (1, 0), (2, 3)], "k int, n int")
    assert {r["k"]: (r["is_promoted"], r["reasons"]) for r in enrichment.promoted(evidence, "k", [(F.col("n") > 0, "none")]).collect()} == {1: (False, ["none"]), 2: (True, [])}
