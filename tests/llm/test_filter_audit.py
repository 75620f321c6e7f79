"""The filter audit against a loop over all orders, and odd rows."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from waymark.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def failed(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((lang or "", d, {k for k, bad in {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": re.search("[#$%&*|]", t), "E": d is not None and least[t] < d}.items() if bad}))
    return out


def by_loop(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    judged, out = failed(rows), []
    for part in {p for p, _, _ in judged}:
        own = [(d, f) for p, d, f in judged if p == part]
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                shapley[f] += len(gone)
                fails = sum(f in x for _, x in own)
                lines.append((part, "".join(order), k + 1, len(left), len(gone), fails - len(gone), sum(x == {f} for _, x in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def long_text(k):
    return " ".join(f"w{i}x{k}" for i in range(120))


ROWS = [(1, None, "en"), (2, "", "en"), (None, "", "en"), (3, long_text(1), "en"), (4, long_text(1), None), (5, long_text(1), ""), (5, long_text(1), "fr"), (6, long_text(2) + " #", "fr"), (7, long_text(3).upper() * 2, "en"), (8, "é😀 Ä " * 90, "de"), (None, long_text(4), "de"), (None, long_text(4), "de"), (9, "a\x1fb a b\t\v" * 70, "en"), (10, "word " * 40_000, "en")]
MARKS = [(1, 1, 1), (3, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1), (6, None, None), (7, 1, 0), (99, 1, 1)]


def test_audit_equals_a_loop_over_all_orders(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "1 AS part", "'x' AS state", "true AS good", "2 AS digest").repartition(3)
    rows = filter_audit.marked(filter_audit.judged(docs), spark.createDataFrame(MARKS, LABELS))
    got = [tuple(r) for r in filter_audit.interactions(rows).collect()]
    assert sorted(got) == by_loop(ROWS, MARKS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.interactions(filter_audit.marked(filter_audit.judged(docs), none)).count() == 0
    some = spark.createDataFrame(ROWS[:4], docs.schema)
    assert sorted(map(tuple, filter_audit.interactions(filter_audit.marked(filter_audit.judged(some), none)).collect())) == by_loop(ROWS[:4], [])


def test_states_are_computed_once(spark, tmp_path):
    held = spark.range(50).select(F.lit("p").alias("part"), (F.col("id") % 2 == 0).alias("A"), (F.col("id") % 3 == 0).alias("B"), (F.col("id") % 5 == 0).alias("C"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    trie = filter_audit.Trie("ABC", f"{tmp_path}/edges")
    trie.visit(held)
    edges = spark.read.parquet(f"{tmp_path}/edges").collect()
    assert len(trie.done) == 8 and len(edges) == 12 == len({(r["state"], r["filter"]) for r in edges})
    assert {(r["state"], r["filter"]): r["removed"] for r in edges}[("AB", "C")] == sum(i % 2 and i % 3 and i % 5 == 0 for i in range(50))
    assert not spark.sparkContext._jsc.getPersistentRDDs()
