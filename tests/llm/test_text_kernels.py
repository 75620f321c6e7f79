"""Pieces without Spark, against brute force."""

import collections
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import decontamination, language_id, near_dedup, packing, quality_classifier, quality_rules, substring_dedup
from waymark.llm.suffix_array import common_prefixes, suffix_array
from waymark.llm.textkernel import shingles, split_words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(text):
    order = suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    shared = common_prefixes(text, order)
    for k in range(1, len(text)):
        a, b = text[order[k - 1] :], text[order[k] :]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffix_array_of_periods():
    r = random.Random(1)
    for period in (1, 2, 3, 5, 7):
        text = [r.randint(1, 3) for _ in range(period)] * 40
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n\t\u00a0é😀", max_size=30), min_size=1, max_size=5))
def test_words_and_shingles(texts):
    words = split_words(texts)
    assert np.bincount(words.doc, minlength=len(texts)).tolist() == [len(WORDS.findall(t)) for t in texts]
    docs, hashes = shingles(words)
    expected = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORDS.findall(t)) else set() for t in texts]
    assert [len(set(hashes[docs == i].tolist())) for i in range(len(texts))] == [len(x) for x in expected]


def test_repeat_words_is_brute_force():
    r = random.Random(2)
    for _ in range(50):
        w = [r.choice("abc") for _ in range(r.randint(0, 60))]
        seen, covered = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                covered |= {p + k for p in places for k in range(8)}
        assert quality_rules.repeat_words(split_words([" ".join(w)])).tolist() == [len(covered)]


def test_prob_min_hash_estimates_probability_jaccard():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(300)]
    line = " ".join(word() for _ in range(12)) + " "
    texts = [" ".join(common) + " " + line * 6, " ".join(common[:240] + [word() for _ in range(60)]) + " " + line * 3, word(), ""]
    own, hashes, weights = near_dedup.weighted_shingles(split_words(texts))
    present, registers = near_dedup.prob_min_hash(own, hashes, weights, len(texts))
    assert present.tolist() == [0, 1, 2] and len(set(registers[2].tolist())) == 1
    part = lambda i: (hashes[own == i], weights[own == i])
    a, b = (dict(zip(*(x.tolist() for x in part(i)))) for i in (0, 1))
    brute = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    assert abs(near_dedup.probability_jaccard(*part(0), *part(1)) - brute) < 1e-9
    assert abs((registers[0] == registers[1]).mean() - brute) < 0.2
    assert abs(near_dedup.jaccard(part(0)[0], part(1)[0]) - len(a.keys() & b.keys()) / len(a.keys() | b.keys())) < 1e-12


def test_items_in_long_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (1, 4, 5, 8, 20, 33, 70, 150)]
    texts = [" ".join(word() for _ in range(3000)) for _ in range(4)]
    for i, item in enumerate(items):
        texts[i % 4] += " " + item + " " + " ".join(word() for _ in range(500))
    texts.append(items[1])
    docs, hashes = shingles(split_words(items))
    index = decontamination.ItemIndex([np.unique(hashes[docs == i]) for i in range(len(items))])
    sets = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORDS.findall(t)) else set()
    brute = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if len(sets(item) & sets(t)) >= 0.8 * len(sets(item))}
    assert {(d, i) for d, i, _ in index.matches(texts, 0.8)} == brute and len(brute) == 7
    assert index.matches(["", "x"], 0.8) == []


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(left, k) for k, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_packing_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    table = packing.plan(histogram, 50)
    filled: dict[int, list[tuple[int, int]]] = {}
    for n, count in histogram.items():
        rows = [r for r in table.tolist() if r[0] == n]
        for rank in range(count):
            _, first, bin_, each, offset = max((r for r in rows if r[1] <= rank), key=lambda r: r[1])
            filled.setdefault(bin_ + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
    for pieces in filled.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 50
    assert sorted(50 - sum(n for _, n in p) for p in filled.values()) == best_fit(lengths, 50)


def kneser_ney_by_dictionaries(texts, order=4):
    """Interpolated Kneser-Ney in plain dictionaries: a function of (context, symbol)."""
    folded = ["".join(c if c.isalpha() else " " for c in t.lower()) for t in texts]
    grams = collections.Counter()
    for t in folded:
        t = re.sub(" +", " ", t)
        t = t if t.startswith(" ") is False else t[1:]
        padded = " " * (order - 1) + t + ("" if t.endswith(" ") or not t else " ")
        for i in range(order - 1, len(padded)):
            grams[padded[i - order + 1 : i + 1]] += 1
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    return counts


def test_kneser_ney_is_a_distribution():
    texts = {"x": ["abab abba baba", "aab"], "y": ["cd cdc dcd"]}
    tables = [kneser_ney_by_dictionaries(own) for own in texts.values()]
    counts = []
    for own, table in zip(texts.values(), tables):
        packed = language_id.grams(own)[0]
        keys, n = np.unique(packed, return_counts=True)
        by_text = {"".join(chr((int(k) >> (16 * (3 - j))) & 0xFFFF) for j in range(4)): int(c) for k, c in zip(keys, n)}
        assert by_text == dict(table[4])
        counts.append((keys, n))
    model = language_id.kneser_ney(counts)
    symbols = sorted({g[-1] for t in tables for g in t[1]})
    none = 1 / (len(symbols) + 1)

    def brute(table, context, symbol):
        p = none
        for k in range(1, 5):
            c = context[len(context) - k + 1 :] if k > 1 else ""
            own = {g: n for g, n in table[k].items() if g[:-1] == c}
            once, twice = (sum(n == m for n in table[k].values()) for m in (1, 2))
            discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
            if own:
                total = sum(own.values())
                p = max(own.get(c + symbol, 0) - discount, 0) / total + discount * len(own) / total * p
        return p

    def stored(column, context, symbol):
        text = context + symbol
        key = sum(ord(c) << (16 * (3 - j)) for j, c in enumerate(text))
        log = 0.0
        for k in range(4, 0, -1):
            own = language_id.suffix(np.array([key], dtype=np.uint64), k)
            at, has = language_id.find(model["gram"][k - 1], language_id.hashed(own, k))
            if has[0]:
                return math.exp(log + model["p"][k - 1][at[0], column])
            at, has = language_id.find(model["context"][k - 1], language_id.hashed(own >> np.uint64(16), k - 1))
            log += float(model["back"][k - 1][at[0], column]) if has[0] else 0.0
        return math.exp(log + model["none"])

    for column, table in enumerate(tables):
        for context in ("   ", " ab", "bab", "cdc", "zzz", "a c"):
            known = [stored(column, context, s) for s in symbols]
            assert all(abs(p - brute(table, context, s)) < 1e-5 for p, s in zip(known, symbols))
            assert abs(sum(known) + stored(column, context, "ž") - 1) < 1e-4
    best, margin = language_id.margins(language_id.entropies(["ababab", "cdcd"], model)[0])
    assert best.tolist() == [0, 1] and (margin > 0).all()


def test_random_indexing_is_brute_force():
    """Context sums and pooled vectors against loops over words."""
    r = random.Random(13)
    texts = [" ".join(r.choice(["ab", "cd1", "e,f", "!!", "ghi"]) for _ in range(r.randint(0, 12))) for _ in range(20)] + ["", "  ", "é"]
    index = quality_classifier.index_vectors()
    buckets, first = quality_classifier.bucketed(texts)
    own = [buckets[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    pieces = lambda t: [m[0] for m in re.finditer(r"[^\W\d_]+|\d+|(?:[^\w\x20\x09-\x0D]|_)+", t)]
    assert [len(o) for o in own] == [len(pieces(t)) for t in texts]
    total, seen = np.zeros((quality_classifier.BUCKETS, quality_classifier.DIM)), np.zeros(quality_classifier.BUCKETS)
    for o in own:
        for i, b in enumerate(o):
            seen[b] += 1
            for j in range(max(0, i - quality_classifier.REACH), min(len(o), i + quality_classifier.REACH + 1)):
                if j != i:
                    total[b] += index[o[j]]
    got_total, got_seen = quality_classifier.context_sums([texts[:9], texts[9:]])
    assert (got_seen == seen).all() and (got_total == total).all()
    vectors, weight = quality_classifier.word_vectors(total, seen)
    pooled = quality_classifier.pooled(texts, vectors, weight)
    for o, row in zip(own, pooled):
        if not o:
            assert not row.any()
            continue
        v, w = vectors[o], weight[o][:, None]
        expected = np.concatenate([v.mean(axis=0), (v * w).sum(axis=0) / w.sum(), sum((v[i] * v[i + 1] for i in range(len(o) - 1)), np.zeros(v.shape[1])) / len(o), [np.log1p(len(o)) / 5]])
        assert np.allclose(row, expected, atol=1e-4)


def test_quality_features_are_brute_force():
    """Lines, hashed features and the verdict of the rules against loops."""
    texts = ["a b\na b\n\na b\nc", "", " \n ", "word " * 30, "é#x $y\n\té#x $y"]
    lines = lambda t: [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert [quality_rules.dup_lines(t) for t in texts] == [sum(x in lines(t)[:i] for i, x in enumerate(lines(t))) for t in texts]
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    golden, base = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
    word_hash = lambda w: mix((sum(mix((ord(c) + golden) & mask) * pow(base, k, 1 << 64) for k, c in enumerate(w)) + len(w)) & mask)
    got = quality_rules.features(split_words(texts))
    rng = np.random.default_rng(3)
    model = {"w": rng.normal(size=quality_rules.DIMS).astype(np.float32), "b": 0.1}
    for t, row in zip(texts, got):
        h = [word_hash(w) for w in WORDS.findall(t)]
        words, chars = np.zeros(quality_rules.WORD_DIMS), np.zeros(quality_rules.CHAR_DIMS)
        for x in [*h, *(mix((a * base + b) & mask) for a, b in zip(h, h[1:]))]:
            words[x % quality_rules.WORD_DIMS] += 1
        points = [ord(c) for c in t + "\n"]
        for a, b, c in zip(points, points[1:], points[2:]):
            chars[mix((a << 42) | (b << 21) | c) % quality_rules.CHAR_DIMS] += 1
        expected = np.concatenate([np.sqrt(x) / np.sqrt(max(x.sum(), 1)) for x in (words, chars)])
        assert np.allclose(row, expected, atol=1e-5)
        p = 1 / (1 + math.exp(-float(expected @ model["w"] + model["b"])))
        assert abs(quality_rules.probabilities(split_words([t]), model)[0] - p) < 1e-4


def test_repeats_in_one_task_are_brute_force():
    r = random.Random(6)
    base = bytes(r.choice(b"abcdef ") for _ in range(1500))
    texts = [base, base[200:900] + bytes(r.choice(b"xyz ") for _ in range(500)) + base[950:1450], b"", base[:399], b"q" * 950]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    whole, bounds, (own, first, windows, place, core) = substring_dedup.anchors(texts)
    groups: dict[int, list[dict]] = {}
    for o, f, w, p, c in zip(own.tolist(), first.tolist(), windows.tolist(), place.tolist(), core.tolist()):
        groups.setdefault(c, []).append({"left": p - f, "windows": w, "start": f, "n": 1, "raw": whole[f : f + w + 399]})
    assert sum(windows.tolist()) == sum(max(0, len(t) - 399) for t in texts)
    refined, rows = substring_dedup.Refined(), []
    for g in groups.values():
        refined.add(g, len(rows))
        rows += g
    found = {w for _, w in refined.repeated()}
    expected = {bounds[d] + i for d, t in enumerate(texts) for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1}
    assert found == expected and expected
