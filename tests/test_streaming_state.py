"""Debounce and stale responses: streams in several batches against the batch form, late and idle keys, and the size of the state."""

import random
import time
from datetime import datetime, timedelta

import pytest

from waymark.streaming import state

START = datetime(2024, 5, 1, 12)
SCHEMA = "k string, at timestamp, v int"
ASKED = "k string, kind string, n long, at timestamp, v string"


def moment(ms):
    return START + timedelta(milliseconds=ms)


def run(spark, tmp_path, batches, schema, make, name):
    """Rows that a query gives over batches in this order, and its progress reports."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 if k + 1 < len(batches) else 0)  # files are taken in the order of their times
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return [tuple(r) for r in spark.table(name).collect()], q.recentProgress
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def quiet_ones(events, quiet=300):
    """Of (key, ms, value) the events that no other of their key follows within the time."""
    out = []
    for key in {e[0] for e in events}:
        own = sorted((ms, v) for k, ms, v in events if k == key)
        out += [(key, ms, v) for i, (ms, v) in enumerate(own) if i + 1 == len(own) or own[i + 1][0] - ms >= quiet]
    return sorted(out)


def test_debounce_of_a_table(spark):
    r = random.Random(1)
    events = [(r.choice("abc"), r.randint(0, 6000), r.randint(0, 3)) for _ in range(80)]
    events += [("d", 0, 1), ("d", 300, 2), ("d", 599, 3), ("d", 599, 4)]
    table = spark.createDataFrame([(k, moment(ms), v) for k, ms, v in events] + [(None, START, 1), ("a", None, 1)], SCHEMA)
    got = sorted((x["k"], round((x["at"] - START).total_seconds() * 1000), x["v"]) for x in state.debounced(table, "k", "at").collect())
    assert got == quiet_ones(events)
    assert [e for e in got if e[0] == "d"] == [("d", 0, 1), ("d", 599, 4)]


def test_debounce_of_a_stream(spark, tmp_path):
    r = random.Random(2)
    # within the delay of the watermark events come in any order; the last batch moves the watermark beyond all others
    first = [(r.choice("abc"), r.randint(0, 4000), k) for k in range(40)]
    second = [(r.choice("abc"), r.randint(0, 8000), 100 + k) for k in range(40)]
    rest = [("z", 60_000, 0)]
    late = [("a", 10, 999)]  # behind the watermark
    rows, progress = run(spark, tmp_path, [[(k, moment(ms), v) for k, ms, v in part] for part in (first, second, rest, late + [("z", 120_000, 1)])], SCHEMA, lambda df: state.debounce(df, "k", "at"), "debounce")
    got = sorted((k, round((at - START).total_seconds() * 1000), v) for k, at, v in rows)
    assert got == quiet_ones(first + second) + [("z", 60_000, 0)]
    assert progress[-1]["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] >= 0


def test_state_of_debounce_is_given_up(spark, tmp_path):
    keys = [[(f"k{i}", moment(ms + i), i) for i in range(50)] for ms in (0, 100_000, 200_000)]
    rows, progress = run(spark, tmp_path, [*keys, [("end", moment(400_000), 0)]], SCHEMA, lambda df: state.debounce(df, "k", "at"), "debounce_state")
    assert len(rows) == 150
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert totals[-1] < 10 < max(totals)


REQUESTS = [("a", "request", 1, 0, "q1"), ("a", "request", 2, 100, "q2"), ("a", "response", 1, 150, "stale"), ("a", "response", 2, 200, "fresh"), ("b", "response", 7, 50, "unknown"), ("c", "request", 1, 0, "q"), ("c", "response", 1, 0, "same time")]


@pytest.mark.parametrize("together", [True, False])
def test_stale_responses_are_dropped(spark, tmp_path, together):
    rows = [(k, kind, n, moment(ms), v) for k, kind, n, ms, v in REQUESTS]
    table = spark.createDataFrame(rows + [("a", "response", None, START, "no number"), (None, "response", 2, START, "no key")], ASKED)
    assert sorted(r["v"] for r in state.fresh_of(table, "k", "kind", "n", "at").collect()) == ["fresh", "same time"]
    batches = [rows] if together else [rows[:3] + rows[4:], rows[3:4]]
    got, _ = run(spark, tmp_path, batches, ASKED, lambda df: state.fresh_responses(df, "k", "kind", "n", "at"), f"fresh_{together}")
    assert sorted(r[4] for r in got) == ["fresh", "same time"]


def test_idle_keys_are_forgotten(spark, tmp_path):
    minutes = lambda m: moment(60_000 * m)
    batches = [[("a", "request", 1, minutes(0), "q"), ("b", "request", 1, minutes(0), "q")], [("b", "request", 2, minutes(9), "q"), ("x", "request", 1, minutes(9), "q")], [("x", "request", 2, minutes(12), "q")], [("a", "response", 1, minutes(13), "forgotten"), ("b", "response", 2, minutes(13), "known"), ("b", "response", 1, minutes(13), "stale")]]
    got, progress = run(spark, tmp_path, batches, ASKED, lambda df: state.fresh_responses(df, "k", "kind", "n", "at"), "idle")
    assert [r[4] for r in got] == ["known"]
    table = spark.createDataFrame(sum(batches, []), ASKED)
    assert [r["v"] for r in state.fresh_of(table, "k", "kind", "n", "at").collect()] == ["known"]
