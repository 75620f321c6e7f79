import time
from datetime import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from waymark import streaming
from waymark.sources import catalogs, pages

HTML = """<table><tr><th>No</th><th>Out</th><th>No</th><th>In</th></tr><tr><td>1</td><td> A&nbsp;b </td><td>1</td><td>D</td></tr><tr><td>2</td><td>B</td><td></td><td></td></tr></table>
<TABLE class="x"><tr><th>Trip</th><th>A</th></tr><tr><td>5:00</td><td>5:10</td></tr></TABLE>"""


def test_html_tables(spark):
    rows = pages.table_rows(spark.createDataFrame([(1, HTML), (2, None), (3, "no table")], "k int, html string"), "k").cache()
    assert rows.count() == 5
    two = {(r["direction"], r["ordinal"], r["name"]) for r in pages.two_way_stops(rows.where(F.col("table") == 0), "k").collect()}
    assert two == {("outbound", 1, "A b"), ("inbound", 1, "D"), ("outbound", 2, "B")}
    trip = pages.timetables(rows.where(F.col("table") == 1), "k").first()
    assert trip["departure"] == "5:00" and trip["timeline"] == {"Trip": "5:00", "A": "5:10"}
    one = [(r["ordinal"], r["name"]) for r in pages.one_way_stops(rows.where(F.col("table") == 1), "k", ["trip"]).collect()]
    assert one == [(1, "5:00")]


def rows_of(html):
    return [(t, around, r, cells) for t, around, r, cells in pages.Tables().of(html)]


def test_nested_and_unclosed_tables(spark):
    assert rows_of("<table><tr><td>a<td>b<tr><td>c</table>") == [(0, None, 0, ["a", "b"]), (0, None, 1, ["c"])]
    assert rows_of("<table><tr><td>x<table><tr><td>in<tr><td>ner</table>y</td><td>z</td></tr><tr><th>q</table>") == [(0, None, 0, ["xinnery", "z"]), (0, None, 1, ["q"]), (1, 0, 0, ["in"]), (1, 0, 1, ["ner"])]
    # a table and a row left open, a cell without a row, a row without cells, text outside of cells, tags that are none
    assert rows_of("t<table><caption>c</caption><td>1 < 2 &lt; 3<td>b") == [(0, None, 0, ["1 < 2 < 3", "b"])]
    assert rows_of("<table><tbody><tr></tr>x<tr><td></td></tbody><tfoot><td>f</tfoot></table></table></td><td>no") == [(0, None, 0, []), (0, None, 1, [""]), (0, None, 2, ["f"])]
    assert rows_of("<table><tr><td>a<!-- <td>no --><b>b</b><br>c</td></tr></table><TABLE><TR><TD a='<td>'>d") == [(0, None, 0, ["abc"]), (1, None, 0, ["d"])]
    assert rows_of("") == rows_of("<tr><td>x</td></tr>") == []
    deep = "<table><tr><td>" * 300 + "x"
    assert [(t, around) for t, around, _, _ in rows_of(deep)] == [(0, None)] + [(k, k - 1) for k in range(1, 300)]
    table = spark.createDataFrame([("k1", deep), (None, "<table><td>n"), ("k2", None), ("k3", "")], "name string, html string").repartition(3)
    found = pages.table_rows(table, "name").collect()
    assert len(found) == 301 and [r["cells"] for r in found if r["name"] is None] == [["n"]]
    assert pages.table_rows(table.limit(0), "name").count() == 0


def test_line_ranges(spark):
    texts, ranges = spark.createDataFrame([(1, "a\nb\nc")], "k int, t string"), spark.createDataFrame([(1, "x", 2, 3)], "k int, part string, first_line int, last_line int")
    assert [r["line"] for r in pages.line_ranges(texts, ranges, "k", "t").orderBy("at").collect()] == ["b", "c"]


def test_catalog_round_trip(spark, tmp_path):
    (tmp_path / "streets.json").write_text('{"route_id":"1","direction":"outbound","pos":1,"street":"A"}\n')
    tables = catalogs.load(spark, f"file://{tmp_path}", ["streets"])
    assert catalogs.health(tables) == {"streets": 1}
    first = catalogs.publish(tables["streets"], f"file://{tmp_path}/out")
    before = catalogs.published(spark, f"file://{tmp_path}/out")
    second = catalogs.publish(tables["streets"].unionByName(tables["streets"]), f"file://{tmp_path}/out")
    # a reader of the old version keeps it
    assert first != second and before.count() == 1 and catalogs.published(spark, f"file://{tmp_path}/out").count() == 2
    assert catalogs.constants(spark, "streets", [("1", "outbound", 1, "A")]).count() == 1
    (tmp_path / "streets.json").write_text("{broken\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        catalogs.load(spark, f"file://{tmp_path}", ["streets"])["streets"].collect()


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", lambda n: spark.range(n)
    assert catalogs.publish(rows(1), path) == 1
    # both have read version 1
    assert catalogs.publish(rows(2), path, after=1) == 2
    with pytest.raises(catalogs.Conflict):
        catalogs.publish(rows(3), path, after=1)

    class Slow:
        """Rows whose writing lets another writer be first."""

        sparkSession = spark

        @property
        def write(self):
            catalogs.publish(rows(4), path)
            return rows(5).write

    with pytest.raises(catalogs.Conflict):
        catalogs.publish(Slow(), path)
    assert catalogs.versions(spark, path) == [1, 2, 3] and catalogs.published(spark, path).count() == 4
    assert len([d for d in (tmp_path / "t").iterdir() if d.name.startswith("data-")]) == 3  # the refused writer's data are gone
    assert catalogs.published(spark, path, version=1).count() == 1


def test_old_versions_and_claims(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(ValueError):
        catalogs.published(spark, path)
    for n in range(1, 5):
        catalogs.publish(spark.range(n).withColumn("p", F.col("id") % 2), path, "json", ["p"])
    # a writer that ended between its claim and its content
    claim = tmp_path / "t" / "_versions" / "0000000005"
    claim.touch()
    (tmp_path / "t" / "data-left").mkdir()
    assert catalogs.published(spark, path, "json").count() == 4
    with pytest.raises(catalogs.Conflict):
        catalogs.publish(spark.range(1), path)
    assert catalogs.withdraw(spark, path) and not catalogs.withdraw(spark, path) and not claim.exists()
    before = catalogs.published(spark, path, "json")
    assert catalogs.prune(spark, path, 2) == [1, 2] and (tmp_path / "t" / "data-left").exists()
    assert catalogs.prune(spark, path, 2, hours=-1.0) == [] and not (tmp_path / "t" / "data-left").exists()
    assert catalogs.versions(spark, path) == [3, 4] and before.count() == 4
    assert catalogs.publish(spark.range(9), path, "json") == 5
    with pytest.raises(ValueError):
        catalogs.published(spark, path, "json", 1)
    with pytest.raises(ValueError):
        catalogs.prune(spark, path, 0)


def test_patches_win_with_nulls(spark):
    rows, patches = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int"), spark.createDataFrame([(1, None)], "k int, v string")
    assert {tuple(r) for r in catalogs.patched(rows, patches, "k", ["v"]).collect()} == {(1, None, 1), (2, "b", 2)}


def test_streams(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, m), m) for m in (0, 5, 50)] + [(2, datetime(2024, 1, 2), 0), (2, datetime(2024, 1, 3), 0)]
    spark.createDataFrame(rows, "k int, at timestamp, n int").repartition(1).write.parquet(f"{tmp_path}/in")
    schema = "k int, at timestamp, n int"
    for name, make, mode in [("s1", lambda df: streaming.sessions(df, "k", "at"), "append"), ("s2", lambda df: streaming.counts(df, "k", "at"), "append"), ("s3", lambda df: streaming.latest_only(df, "k", "n"), "complete")]:
        stream = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted((r["k"], r["n"]) for r in spark.table("s1").collect())[:2] == [(1, 1), (1, 2)]
    assert spark.table("s2").count() >= 3 and {r["k"]: r["n"] for r in spark.table("s3").collect()} == {1: 50, 2: 0}


def test_late_responses_change_nothing(spark, tmp_path):
    seen = []
    spark.createDataFrame([(1, 5, "new")], "k int, seq int, v string").write.parquet(f"{tmp_path}/in")
    stream = streaming.latest_only(spark.readStream.schema("k int, seq int, v string").parquet(f"{tmp_path}/in"), "k", "seq")
    for rows in ([], [(1, 4, "stale")], [(1, 6, "newer")]):
        if rows:
            spark.createDataFrame(rows, "k int, seq int, v string").write.mode("append").parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(lambda df, _: seen.append([r["v"] for r in df.collect()])).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert seen == [["new"], ["new"], ["newer"]]


def test_periodic_work(spark, tmp_path):
    times = []
    q = streaming.periodically(spark, lambda now: now, times.append, "1 second", f"{tmp_path}/ticks")
    try:
        for _ in range(60):
            if len(times) > 1:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert len(times) > 1 and times == sorted(times)
