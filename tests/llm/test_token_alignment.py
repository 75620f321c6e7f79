"""Alignment of tokens against loops over bytes."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from waymark.llm import packing, token_alignment

SF = "/root/testdata/sf0.001"
PATHS = token_alignment.tokenizer_paths()
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "one two three", "x\n\ny", "x \n y", "a\tb c\r\nd", "don't stop, it's 12,345.67!", "naïve café 日本語 テスト", "😀😀 é é ﬁ  x   y",
    "<|endoftext|> is <s>text</s> <unk>", "▁x y", "x ▁ y", "x ▁y z", "a▁b", "\x00 \x1f a\x85b c \x1c d", "no" * 3000, "日本語" * 400, "x" * 5000, "word " * 300, "　a　 b   c", "tail  \n", "()[]{};:'\"\\  ==  !=", "á ́b", "﻿a ​b ​ c",
]


class Slow:
    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.byte_of = {s: b for b, s in enumerate(packing.byte_symbols())}

    def groups(self, text):
        """Lists of (ids and ends) of both, or nothing."""
        if not text:
            return [], []
        raw = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        a_raw = [bytes(self.byte_of[c] for c in self.a.id_to_token(i)) for i in a]
        b_raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            return [], []
        out = []
        for ids, spelled in ((a, a_raw), (b, b_raw)):
            at, rows = 0, []
            for i, x in zip(ids, spelled, strict=True):
                rows.append((i, at, at + len(x)))
                at += len(x)
            out.append(rows)
        return out


def brute(rows):
    slow, held, found = Slow(), Counter(), []
    for doc_id, text in rows:
        a, b = slow.groups(text)
        links, k = [], 0
        for i, s, e in a:
            while k and b[k - 1][2] > s:
                k -= 1
            while k < len(b) and b[k][2] <= s:
                k += 1
            links += [(i, x) for x, s2, e2 in b[k : k + 60] if s2 < e and s < e2]
            assert k + 60 >= len(b) or b[k + 60][1] >= e
        held.update(set(links))
        both = {e for _, _, e in a} & {e for _, _, e in b}
        lines = {}
        for side, tokens in enumerate((a, b)):
            g = 0
            for i, _, e in tokens:
                lines.setdefault(g, ([], []))[side].append(str(i))
                g += e in both
        spelled = ";".join("|".join(",".join(x) for x in lines[g]) for g in sorted(lines))
        found.append((doc_id, len(a), len(b), len(both), links, hashlib.sha256(spelled.encode()).hexdigest() if a else ""))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    return sorted(((d, na, nb, g, len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), h) for d, na, nb, g, ls, h in found), key=repr), held


def result(docs):
    rows, counts = token_alignment.alignment(docs, *PATHS)
    return sorted((tuple(r) for r in rows.collect()), key=repr), Counter({(r["a"], r["b"]): r["n"] for r in counts.collect()})


@pytest.mark.parametrize("slice_chars", [6_000_000, 300])
def test_odd_texts_equal_loops(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(token_alignment, "SLICE_CHARS", slice_chars)
    rows = [*enumerate(TEXTS), (None, "one two three"), (None, "one two three"), (3, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS slice", "'x' AS pairs", "true AS is_doc").repartition(4)
    assert result(docs) == brute(rows)


def test_random_texts_equal_loops(spark):
    r = random.Random(4)
    pieces = ["a", "b", "the", " ", " ", "  ", "\n", "'s", "12", "é", " ", "▁", ".", "日", "ing", "\t"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(1, 40)))) for i in range(400)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_documents_equal_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == ([], Counter())


def test_ids_by_ranks_are_those_of_the_file():
    both = token_alignment.tokenizers_of(PATHS)
    slow = Slow()
    assert both.units_are_safe and both.ranks
    for text in TEXTS:
        if text:
            assert both.a_ids(" " + text) == slow.a.encode(" " + text, add_special_tokens=False).ids
            assert sum(([*both.a_ids(" " + u)] for u in both.units(text)), []) == both.a_ids(" " + text)
