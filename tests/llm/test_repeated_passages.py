"""Repeated passages against brute force: arrays of words, random tables and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from waymark.llm import repeated_passages as rp

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def text_hash(spark, texts):
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i int, t string").selectExpr("i", "xxhash64(t) AS h")
    return [h for _, h in sorted(tuple(r) for r in df.collect())]


def brute(rows, hashes):
    """rows of (doc_id, text); the order of documents is id (null first), then the text's hash."""
    key = [(-(1 << 63) if d is None else d, h) for (d, _), h in zip(rows, hashes, strict=True)]
    seen, gone = {}, [set() for _ in rows]
    words = [WORDS.findall(t or "") for _, t in rows]
    for k, i in sorted((key[i], i) for i in range(len(rows))):
        w = words[i]
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (k, s)) < (k, s):
                gone[i] |= set(range(s, s + 20))
    out = []
    for (d, _), w, g in zip(rows, words, gone, strict=True):
        kept = " ".join(x for k, x in enumerate(w) if k not in g)
        out.append((d, len(w), len(g), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k1", "2 AS anchor", "'x' AS firsts").repartition(3)
    out = rp.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()
    return sorted((tuple(r) for r in out), key=repr)


def test_every_difference_is_in_the_cover():
    assert {(a - b) % rp.PERIOD for a in rp.COVER for b in rp.COVER} == set(range(rp.PERIOD))
    for i in range(rp.PERIOD):
        for j in range(rp.PERIOD):
            shifts = [t for t in range(rp.PERIOD) if (i + t) % rp.PERIOD in rp.COVER and (j + t) % rp.PERIOD in rp.COVER]
            assert shifts and shifts[0] + rp.ANCHOR <= rp.WINDOW


def test_anchors_and_windows_hash_what_they_say():
    r = random.Random(3)
    texts = ["", "a b", " ".join(r.choice("ab") for _ in range(60)), " ".join(r.choice("ab") for _ in range(20)), "x " * 300]
    words = [WORDS.findall(t) for t in texts]
    doc, first, end, anchor, context = rp.anchors(texts)
    places = [(d, p) for d, w in enumerate(words) if len(w) >= 20 for p in range(len(w) - rp.ANCHOR + 1) if p % rp.PERIOD in rp.COVER]
    assert [(d, max(0, p - 12), min(len(words[d]), p + rp.ANCHOR + 12)) for d, p in places] == list(zip(doc.tolist(), first.tolist(), end.tolist(), strict=True))
    by = {}
    for (d, p), a, c, f, e in zip(places, anchor.tolist(), context.tolist(), first, end, strict=True):
        assert by.setdefault(("a", *words[d][p : p + rp.ANCHOR]), a) == a
        assert by.setdefault(("c", p - f, *words[d][f:e]), c) == c
    assert len(set(by.values())) == len(by)
    doc, first, w1, w2 = rp.windows(texts, [[], [], [(0, 25), (3, 30)], [(0, 20)], [(280, 300)]])
    assert list(zip(doc.tolist(), first.tolist(), strict=True)) == [(2, s) for s in range(11)] + [(3, 0), (4, 280)]
    assert len(set(zip(w1.tolist(), w2.tolist(), strict=True))) == len({tuple(words[d][s : s + 20]) for d, s in zip(doc, first, strict=True)})


@pytest.mark.parametrize("held", [None, 1, 2])
def test_settling(held):
    anchor = np.array([7, 7, 7, 7, 8, 9, 9], dtype=np.int64)
    context = np.array([1, 2, 1, 3, 4, 5, 5], dtype=np.int64)
    k1 = np.array([5, 4, 3, 2, 1, 6, 6], dtype=np.int64)
    rows = {"anchor": anchor, "context": context, "k1": k1, "k2": k1 * 0, "first": np.zeros(7, np.int32), "end": np.full(7, 32, np.int32)}
    got = rp.settle(rows, held)
    seen = sorted(zip(got["anchor"].tolist(), got["context"].tolist(), got["k1"].tolist(), got["kind"].tolist(), strict=True))
    if held is None:
        assert seen == [(7, 1, 3, rp.CONTESTED), (7, 1, 5, rp.REPEATED), (7, 2, 4, rp.CONTESTED), (7, 3, 2, rp.CONTESTED)]
    else:
        kinds = [rp.SHIPPED] * held + [rp.CONTESTED] * (3 - held)
        firsts = sorted(zip([7] * 3, [1, 2, 3], [3, 4, 2], kinds, strict=True))
        assert seen == sorted([*firsts, (7, 1, 5, rp.REPEATED), (8, 4, 1, rp.SHIPPED), (9, 5, 6, rp.SHIPPED)])


def test_random_tables_equal_brute_force(spark, monkeypatch):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = [r.choice(vocabulary) for _ in range(20)]
    passage = [r.choice(vocabulary) for _ in range(90)]
    rows = []
    for i in range(160):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 160))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            a = r.randint(0, 60)
            w[at:at] = r.choice([line, passage[a : a + r.randint(15, 40)], passage, ["w1"] * r.randint(1, 70), ["w1", "w2", "w3"] * r.randint(1, 15)])
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    rows += [(1000 + k, rows[k][1]) for k in range(20)]
    r.shuffle(rows)
    assert result(spark, rows) == brute(rows, text_hash(spark, [t for _, t in rows]))
    # many settlements in a task, and groups that span batches
    monkeypatch.setattr(rp, "SETTLED", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert result(spark, rows) == brute(rows, text_hash(spark, [t for _, t in rows]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    r = random.Random(5)
    long = " ".join(r.choice("abcdefg") * r.randint(1, 3) for _ in range(30_000))
    a, b = (" ".join(f"{x}{i}" for i in range(25)) for x in "ab")
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, long), (6, long), (None, a), (None, a), (None, b + " " + a), (7, a), (7, b), (7, b), (7, a + " " + b), (8, a.replace(" ", "\x0b")), (9, " ".join(a.split()[:19])), (10, " ".join(a.split()[:20]))]
    assert result(spark, rows) == brute(rows, text_hash(spark, [t for _, t in rows]))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rp.without_repeats(empty).count() == 0
