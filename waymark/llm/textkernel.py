"""Vectorised views of a list of texts: code points, words, word hashes and shingles, as numpy arrays over all texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
#: Odd multiplier of the polynomial word hash.
BASE = U64(0xD1342543DE82EF95)
_powers = np.ones(1, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the result."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 1024), BASE, dtype=U64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


@dataclass
class Words:
    """Words of a list of texts: ``start``/``end`` index ``points``, ``doc`` is the text's number, ``hash`` the 64-bit word hash."""

    points: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, each text followed by one newline; text i is points[bounds[i] : bounds[i+1] - 1]."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(lengths + 1)])


def split_words(texts: list[str], points: np.ndarray | None = None, bounds: np.ndarray | None = None) -> Words:
    """Words are maximal runs of code points other than U+0020 and U+0009 to U+000D."""
    if points is None:
        points, bounds = code_points(texts)
    inside = ~((points == 32) | ((points >= 9) & (points <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    start, end = edges[::2], edges[1::2]
    doc = np.searchsorted(bounds, start, side="right") - 1
    if not len(start):
        return Words(points, bounds, start, end, doc, np.zeros(0, U64), len(texts))
    length = end - start
    chars = mix(points[inside].astype(U64) + GOLDEN)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(chars)) - np.repeat(first, length)
    hashed = mix(np.add.reduceat(chars * powers(int(length.max()))[place], first) + length.astype(U64))
    return Words(points, bounds, start, end, doc, hashed, len(texts))


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``n`` words; a text of 1 to n-1 words has one shingle of all of them."""
    h, doc = words.hash, words.doc
    if not len(h):
        return doc[:0], h[:0]
    count = np.bincount(doc, minlength=words.n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    multiplier = powers(n + 1)
    whole = np.zeros(max(0, len(h) - n + 1), dtype=U64)
    for k in range(n):
        whole += h[k : len(h) - n + 1 + k] * multiplier[k + 1] if len(whole) else whole
    same = doc[: len(whole)] == doc[n - 1 :] if len(whole) else np.zeros(0, bool)
    docs, out = doc[: len(whole)][same], mix(whole[same])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), dtype=U64)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] += h[first[short[has]] + k] * multiplier[k + 1]
        docs, out = np.concatenate([docs, short]), np.concatenate([out, mix(extra + GOLDEN * count[short].astype(U64))])
    return docs, out
