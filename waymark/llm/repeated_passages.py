"""Exact removal of repeated passages of WINDOW words, found through difference-cover anchors.

Runs of ANCHOR words are hashed only where the place of their first word, modulo PERIOD, is in COVER. Every remainder is the difference of two members of COVER, so two
equal windows, wherever they start, have one such run at the same place within both: for some shift below PERIOD both places are in COVER, and the run still ends inside
the windows (PERIOD - 1 + ANCHOR = WINDOW). Each anchor carries the hash of its context, the words that windows around it can reach (up to PERIOD - 1 on both sides).

1. Occurrences of an anchor with the same context agree in all windows: the first one stands for them, later ones are repeated as far as the context goes.
2. Where an anchor has several contexts, the first of each is extended: hashes of the windows in its context, once for each place, show which windows agree beyond the anchor. Of equal
   windows all but the first are repeated.

No pairs are made at any step. A task settles what it has read before anything is shuffled: of equal contexts it passes on the first, and of an anchor with more than HELD contexts it passes on HELD
(enough to tell all others that there are several) while the rest goes straight to step 2. So the group of an anchor grows with the number of tasks and not with its occurrences. Equal windows meet in partial
aggregates, and joins back are sort-merge joins of stored tables, which adaptive execution splits.

Defined cases: a null text counts as empty; texts under WINDOW words keep all words; null ids stand before all others; rows that share an id stand in the order of their texts' hashes, and
rows that share id and text are one document, so they don't repeat each other; an empty table gives an empty result; texts count whole; other columns do not matter.

Equality rests on 128 bits: of anchor and context (64 each), or of two hashes of a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, text_chunks
from .textkernel import BASE, GOLDEN, U64, Words, mix, powers, split_words

WINDOW = 20
#: A perfect difference set: each remainder but 0 is the difference of exactly one pair.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Anchors that a task settles at once, and contexts of an anchor that it passes on from them.
SETTLED, HELD = 500_000, 2
SHIPPED, CONTESTED, REPEATED = 0, 1, 2
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_inverse = np.ones(1, dtype=U64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        more = np.full(max(n, 1024), INVERSE, dtype=U64)
        more[0] = 1
        _inverse = np.multiply.accumulate(more)
    return _inverse[:n]


class Spans:
    """Hashes of any run of words, from running sums; ``seed`` picks one of many hash functions."""

    def __init__(self, hashes: np.ndarray, seed: int = 0):
        n = len(hashes)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(mix(hashes + U64(seed) * GOLDEN) * powers(n), out=self.sums[1:])
        self.scale = inverse_powers(n + 1)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.scale[first])


def first_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and the place of its first one among all."""
    count = np.bincount(words.doc, minlength=words.n_docs)
    return count, np.concatenate([[0], np.cumsum(count)[:-1]])


def anchors(texts: list[str]) -> tuple[np.ndarray, ...]:
    """For each anchor: text number, first word and end of its context, hashes of anchor and context."""
    words = split_words(texts)
    count, begin = first_words(words)
    place = np.arange(len(words.hash)) - begin[words.doc]
    left = count[words.doc] - place  # words of the text from here on
    at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (left >= ANCHOR) & (count[words.doc] >= WINDOW))
    before, after = np.minimum(place[at], PERIOD - 1), np.minimum(left[at] - ANCHOR, PERIOD - 1)
    spans = Spans(words.hash)
    context = mix(spans.of(at - before, at + ANCHOR + after) + (before * PERIOD + after).astype(U64) * GOLDEN)
    return words.doc[at], place[at] - before, place[at] + ANCHOR + after, spans.of(at, at + ANCHOR), context


def windows(texts: list[str], wanted: list[list[tuple[int, int]]]) -> tuple[np.ndarray, ...]:
    """For each window inside one of the wanted stretches of a text, once: text number, first word, two hashes."""
    words = split_words(texts)
    count, begin = first_words(words)
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in wanted])
    first, end = np.array([s for w in wanted for s in w], dtype=np.int64).reshape(-1, 2).T
    # +1 where the starts of windows in a stretch begin, -1 behind the last one
    edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(edge, begin[doc] + first, 1)
    np.add.at(edge, begin[doc] + end - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(edge)[:-1])
    return words.doc[at], at - begin[words.doc[at]], Spans(words.hash).of(at, at + WINDOW), Spans(words.hash, 1).of(at, at + WINDOW)


def settle(rows: dict[str, np.ndarray], held: int | None = None) -> dict[str, np.ndarray]:
    """What is known of anchor rows from these rows alone: the kind of each row that still matters.

    Rows later than one with the same anchor and context are REPEATED. Of the others, an anchor's only row stays SHIPPED, as do ``held`` rows of one with several contexts; the rest of these
    is CONTESTED. Without ``held`` the rows are all that there are: single ones are dropped, several are all CONTESTED.
    """
    if not len(rows["anchor"]):
        return rows | {"kind": np.zeros(0, np.int32)}
    order = np.lexsort([rows[k] for k in ("first", "k2", "k1", "context", "anchor")])
    got = {k: v[order] for k, v in rows.items()}
    new_anchor = np.concatenate([[True], got["anchor"][1:] != got["anchor"][:-1]])
    new_context = new_anchor | np.concatenate([[True], got["context"][1:] != got["context"][:-1]])
    leader = np.maximum.accumulate(np.where(new_context, np.arange(len(order)), 0))
    later = ~new_context & np.logical_or.reduce([got[k] != got[k][leader] for k in ("k1", "k2", "first")])
    # contexts of the row's anchor, and the rank of its own among them
    number = np.cumsum(new_context) - 1
    starts = np.flatnonzero(new_anchor)
    base = number[starts]
    group = np.cumsum(new_anchor) - 1
    several = np.diff(np.append(base, number[-1] + 1))[group] > 1
    rank = number - base[group]
    if held is None:
        kind = np.where(later, REPEATED, CONTESTED)
        kept = later | (new_context & several)
    else:
        kind = np.where(later, REPEATED, np.where(rank < held, SHIPPED, CONTESTED))
        kept = later | new_context
    return {k: v[kept] for k, v in got.items()} | {"kind": kind[kept].astype(np.int32)}


def joined_runs(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rows with REPEATED stretches of a document that touch joined into one."""
    done = rows["kind"] == REPEATED
    order = np.lexsort([rows[k][done] for k in ("first", "k2", "k1")])
    got = {k: v[done][order] for k, v in rows.items()}
    if not len(order):
        return rows
    other = np.concatenate([[True], (got["k1"][1:] != got["k1"][:-1]) | (got["k2"][1:] != got["k2"][:-1])])
    number = np.cumsum(other).astype(np.int64) << 32
    reach = np.maximum.accumulate(number + got["end"]) - number
    new = other | np.concatenate([[True], got["first"][1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)
    runs = {k: v[new] for k, v in got.items()} | {"end": reach[last].astype(np.int32)}
    return {k: np.concatenate([v[~done], runs[k]]) for k, v in rows.items()}


def keyed() -> tuple[Column, Column, Column]:
    """A document's key, in the order of documents: its id (the least long if null) and a hash of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text")


NAMES = ("anchor", "context", "k1", "k2", "first", "end", "kind")
ROWS = "anchor long, context long, k1 long, k2 long, first int, end int, kind int"


def batch_of(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[k]) for k in NAMES], names=list(NAMES))


def gathered(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Anchors of all documents, settled within a task as far as it knows. ``anchor`` is a spread value where the row needs no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            rows = joined_runs(settle(gathered(parts), HELD))
            alone = rows["kind"] != SHIPPED
            rows["anchor"][alone] = mix(rows["k1"][alone].view(U64) + rows["first"][alone].astype(U64) * GOLDEN).view(np.int64)
            return batch_of(rows)

        for batch, texts in text_chunks(batches):
            doc, first, end, anchor, context = anchors(texts)
            k1, k2 = (column(batch, k).to_numpy()[doc] for k in ("k1", "k2"))
            parts.append({"anchor": anchor.view(np.int64), "context": context.view(np.int64), "k1": k1, "k2": k2, "first": first.astype(np.int32), "end": end.astype(np.int32)})
            if sum(len(p["k1"]) for p in parts) >= SETTLED:
                yield out()
                parts.clear()
        if parts:
            yield out()

    return docs.select(*keyed()).mapInArrow(run, ROWS)


def met(rows: DataFrame) -> DataFrame:
    """k1, k2, first, end, kind: what the meeting of all rows of an anchor shows."""

    def decided(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        rows = gathered(parts)
        alone = rows["kind"] != SHIPPED
        shipped = settle({k: v[~alone] for k, v in rows.items() if k != "kind"})
        return batch_of(gathered([{k: v[alone] for k, v in rows.items()}, shipped])).select(list(NAMES[2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict[str, np.ndarray]] = []
        for batch in batches:
            rows = {k: column(batch, k).to_numpy() for k in NAMES}
            if not len(rows["anchor"]):
                continue
            # rows come sorted by anchor: the last one's may go on in the next batch
            cut = int(np.searchsorted(rows["anchor"], rows["anchor"][-1]))
            if waiting and (cut or waiting[-1]["anchor"][-1] != rows["anchor"][0]):
                yield decided([*waiting, {k: v[:cut] for k, v in rows.items()}])
                waiting = []
            elif cut:
                yield decided([{k: v[:cut] for k, v in rows.items()}])
            waiting.append({k: v[cut:] for k, v in rows.items()})
        if waiting:
            yield decided(waiting)

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "k1 long, k2 long, first int, end int, kind int")


def of_documents(docs: DataFrame, stretches: DataFrame, how: str) -> DataFrame:
    """The documents (k1, k2, text and their other columns) with the lists ``firsts`` and ``ends`` of their stretches."""
    # rows that share a key share their stretches: a set holds each once
    lists = stretches.groupBy(F.col("k1").alias("s1"), F.col("k2").alias("s2")).agg(F.collect_set(F.struct("first", "end")).alias("s"))
    lists = lists.select("s1", "s2", F.col("s.first").alias("firsts"), F.col("s.end").alias("ends"))
    return docs.join(lists, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), how)


def extended(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """k1, k2, first, end of the windows in contested stretches that an earlier place has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, most=256):
            wanted = [list(zip(a, b, strict=True)) for a, b in zip(column(batch, "firsts").to_pylist(), column(batch, "ends").to_pylist(), strict=True)]
            doc, first, w1, w2 = windows(texts, wanted)
            keys = [pa.array(column(batch, k).to_numpy()[doc]) for k in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(first.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names=["k1", "k2", "first", "w1", "w2"])

    rows = of_documents(docs.select(*keyed()), contested, "inner").select("k1", "k2", "text", "firsts", "ends")
    found = materialize(rows.mapInArrow(run, "k1 long, k2 long, first int, w1 long, w2 long"), "windows", read_once=True)
    place = F.struct("k1", "k2", "first")
    several = found.groupBy(F.col("w1").alias("v1"), F.col("w2").alias("v2")).agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").drop("most")
    later = found.join(materialize(several, "repeated-windows", read_once=True), (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")) & (place > F.col("least")))
    return later.select("k1", "k2", "first", (F.col("first") + WINDOW).alias("end"))


def repeated(docs: DataFrame) -> DataFrame:
    """k1, k2, first, end: stretches of words that repeated windows cover; they may overlap."""
    found = materialize(met(anchor_rows(docs)), "anchors", read_once=True)
    later = extended(docs, found.where(F.col("kind") == CONTESTED).drop("kind"))
    return found.where(F.col("kind") == REPEATED).drop("kind").unionByName(later)


def without_repeats(docs: DataFrame, kept_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (the word runs as first:end) and kept_text (the remaining words joined by spaces) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            out: list[tuple] = []
            for doc_id, text, firsts, ends in zip(column(batch, "doc_id").to_pylist(), texts, column(batch, "firsts").to_pylist(), column(batch, "ends").to_pylist(), strict=True):
                words, runs = text.encode().split(), []  # bytes are split at U+0020 and U+0009 to U+000D
                for a, b in sorted(zip(firsts or [], ends or [], strict=True)):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *[x for r in runs for x in r], len(words)]
                rest = b" ".join([w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]] if runs else words)
                out.append((doc_id, len(words), sum(b - a for a, b in runs), hashlib.sha256(rest).hexdigest(), ",".join(f"{a}:{b}" for a, b in runs), rest.decode() if kept_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])

    rows = of_documents(docs.select("doc_id", *keyed()), repeated(docs), "left").select("doc_id", "text", "firsts", "ends")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed string, kept_text string")


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), kept_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


PASSAGES_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS t FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM words WHERE len(w) >= 20)),
firsts AS (SELECT t, min((doc_id, i)) AS least FROM windows GROUP BY t HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM windows JOIN firsts USING (t) WHERE (doc_id, i) > least),
gone AS (SELECT doc_id, list(DISTINCT k) AS places FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM later) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(coalesce(places, []))::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_transform(list_filter(list_transform(w, lambda x, k: {'x': x, 'k': k - 1}), lambda s: NOT list_contains(places, s.k)), lambda s: s.x) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""
