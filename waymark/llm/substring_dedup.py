"""Exact removal of repeated byte strings of 400 bytes, by suffix sorting of what meets at content-chosen anchors.

In every window of 400 bytes the anchor is the place of the least hash of CORE bytes, leftmost among equals, so equal windows have equal
anchors at equal places. All windows of one anchor form a snippet. Snippets are counted by hashes of core and snippet, a pre-aggregation that
leaves one row for all equal ones: windows of a snippet that occurs again are repeated, and a core with one snippet has nothing to compare.
The snippets of the other cores, the borders of repeats, are cut out of the texts. In a task all snippets of a core are refined by the bytes that
up to 25 neighbouring windows share; these become one symbol, and the suffix array of the rest (Lyndon groups, see ``suffix_array``) shows by the
common prefixes of neighbours which windows occur in another snippet. Cores with more than GROUP snippets are refined and collapsed over the cluster
first; what still has more than GROUP is decided by counting hashes of its windows, which has no group at all.

Defined cases: a null text counts as empty; texts under 400 bytes keep all bytes; null ids are carried; repeated rows are separate documents, so
texts of 400 bytes or more that occur twice lose all bytes; an empty table gives an empty result; texts count whole; other columns do
not matter. Rows that share id and text are cut and compared once, so very many of them cost no more than their number.

Hashes decide that snippets are equal only where their cores are: two snippets count as one if the 64-bit hashes of their cores and the 64-bit
hashes of their bytes, which differ in kind, both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, text_chunks
from .suffix_array import common_prefixes, suffix_array
from .textkernel import BASE, GOLDEN, U64, mix, powers

LENGTH, CORE, STEP = 400, 160, 25
#: Snippets of one core that a task compares by suffix sorting; symbols it sorts at once.
GROUP, SORT_SYMBOLS = 256, 20_000
#: Characters of texts whose windows a task hashes at once.
HASH_CHARS = 400_000
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
PLACE_BITS = 22
SEGMENT = 1 << (PLACE_BITS - 1)
_inverse = np.ones(1, dtype=U64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        more = np.full(n, INVERSE, dtype=U64)
        more[0] = 1
        _inverse = np.multiply.accumulate(more)
    return _inverse[:n]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` bytes."""
    n = len(data)
    symbol = mix(np.arange(256, dtype=U64) + GOLDEN)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(symbol[data] * powers(n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse_powers(n - width + 1))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, ~U64(0))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], length: int = LENGTH, core: int = CORE) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """(all bytes, first byte of each text, columns). A column entry for each anchor: text number, first window, windows, place, hash of the core; places count in all bytes."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    whole = b"".join(texts)
    out: list[list[np.ndarray]] = []
    owner = np.repeat(np.arange(len(texts)), sizes)
    for begin in range(0, max(len(whole) - length + 1, 0), SEGMENT):
        data = np.frombuffer(whole[begin : begin + SEGMENT + length - 1], np.uint8)
        hashes = rolling(data, core)
        low = U64((1 << PLACE_BITS) - 1)
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=U64)
        place = (least_of(ranked, length - core + 1) & low).astype(np.int64)
        own = owner[begin : begin + len(place)]
        inside = own == owner[begin + length - 1 : begin + length - 1 + len(place)]
        change = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])]))
        last = np.append(change[1:], len(place))
        kept = inside[change]
        change, last = change[kept], last[kept]
        out.append([own[change], begin + change, last - change, begin + place[change], hashes[place[change]]])
    return whole, bounds, [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U64)]


def keyed() -> tuple[Column, Column, Column]:
    """A document's key: its id (-1 if null) and a hash of its text; equal rows share it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.coalesce(F.col("doc_id"), F.lit(-1)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text")


ANCHOR = "k1 long, k2 long, core long, snippet long, start int, windows int, left int"


def anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each anchor: document, hashes of core and snippet, first window, number of windows, place of the core after the first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, limit=HASH_CHARS):
            whole, bounds, (own, first, windows, place, core) = anchors([t.encode() for t in texts])
            digest = xxhash.xxh3_64_intdigest
            snippet = np.fromiter((digest(whole[a:b]) for a, b in zip(first.tolist(), (first + windows + LENGTH - 1).tolist(), strict=True)), dtype=U64, count=len(first))
            keys = [pa.array(column(batch, k).to_numpy()[own]) for k in ("k1", "k2")]
            parts = [core.view(np.int64), snippet.view(np.int64), (first - bounds[own]).astype(np.int32), windows.astype(np.int32), (place - first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, parts)], names=["k1", "k2", "core", "snippet", "start", "windows", "left"])

    return docs.select(*keyed()).mapInArrow(run, ANCHOR)


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """k1, k2 and text of the documents, equal rows (which share their key) once. A document of LENGTH bytes has one anchor whose first window is at 0."""
    keys = rows.where("start = 0").groupBy(F.col("k1").alias("r1"), F.col("k2").alias("r2")).agg(F.count("*").alias("c")).where("c > 1").select("r1", "r2")
    keys = materialize(keys, "repeated-rows")
    texts = docs.select(*keyed())
    if not keys.limit(1).count():
        return texts
    same = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))
    return texts.join(keys, same, "left_anti").unionByName(texts.join(keys, same, "left_semi").dropDuplicates(["k1", "k2"]))


def snippets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the snippets that ``wanted`` names by document and place; ``texts`` has k1, k2 and text, each key once."""
    marks = wanted.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(F.collect_list(F.struct("core", "n", "m", "start", "windows", "left")).alias("marks"))
    rows = texts.join(marks, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).select("k1", "k2", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, limit=HASH_CHARS, most=256):
            out: list[tuple] = []
            for k1, k2, text, own in zip(column(batch, "k1").to_pylist(), column(batch, "k2").to_pylist(), texts, column(batch, "marks").to_pylist(), strict=True):
                raw = text.encode()
                out += [(m["core"], m["n"], m["m"], k1, k2, m["start"], m["windows"], m["left"], raw[m["start"] : m["start"] + m["windows"] + LENGTH - 1]) for m in own]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            cols = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["core", "n", "m", "k1", "k2", "start", "windows", "left", "raw"])

    return rows.mapInArrow(run, "core long, n long, m long, k1 long, k2 long, start int, windows int, left int, raw binary")


class Refined:
    """Snippets of several cores on their way to one suffix array."""

    def __init__(self):
        self.text: list[int] = []
        self.asked: list[tuple[int, int, int]] = []  # place in text, row, window
        self.names = 0

    def add(self, rows: list[dict], base: int) -> None:
        """All snippets of one core; ``base`` numbers its first row."""
        groups: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for r, row in enumerate(rows):
            left, low = row["left"], row["left"] - row["windows"] + 1
            for b in range(max(low, 0) // STEP, left // STEP + 1):
                near, far = max(low, STEP * b), min(left, STEP * b + STEP - 1)
                # windows that begin near to far bytes before the anchor share the bytes from STEP * b before it on
                at = left - STEP * b
                shared = row["raw"][at : at + LENGTH - STEP + 1]
                groups.setdefault((b, shared), []).append((r, near, far))
        for (b, _), members in groups.items():
            if len(members) < 2:
                continue
            self.names += 1
            name = -self.names
            for r, near, far in members:
                row = rows[r]
                at = row["left"] - STEP * b
                before, after = row["raw"][row["left"] - far : at], row["raw"][at + LENGTH - STEP + 1 : row["left"] - near + LENGTH]
                if row["n"] == 1:
                    here = len(self.text)
                    self.asked += [(here + k, base + r, row["start"] + row["left"] - far + k) for k in range(far - near + 1)]
                self.text += [x for x in before] + [name] + [x for x in after]
                self.names += 1
                self.text.append(-self.names)  # a symbol of its own ends the snippet

    def repeated(self) -> list[tuple[int, int]]:
        """(row, window) of the asked windows that occur in another snippet as well."""
        if not self.asked:
            return []
        order = suffix_array(self.text)
        shared = common_prefixes(self.text, order)
        place = [0] * len(order)
        for k, i in enumerate(order):
            place[i] = k
        shared.append(0)
        return [(r, w) for i, r, w in self.asked if shared[place[i]] >= STEP or shared[place[i] + 1] >= STEP]


def runs(keys: list[tuple], starts: list[int]) -> list[tuple]:
    """(key, first byte, end) of the stretches that windows at ``starts`` cover; both lists in order."""
    out: list[list] = []
    for key, s in zip(keys, starts, strict=True):
        if out and out[-1][0] == key and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], s + LENGTH)
        else:
            out.append([key, s, s + LENGTH])
    return [(k, a, b) for k, a, b in out]


SPAN = "k1 long, k2 long, first int, end int"


def span_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [[k[0] for k, *_ in rows], [k[1] for k, *_ in rows], [r[1] for r in rows], [r[2] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["k1", "k2", "first", "end"])


def compared(cut: DataFrame) -> DataFrame:
    """Repeated stretches of the snippets of each core, by suffix sorting. Whole cores come to a task, GROUP snippets of each at most."""

    def decide(waiting: list[list[dict]]) -> pa.RecordBatch:
        refined, rows = Refined(), []
        for group in waiting:
            refined.add(group, len(rows))
            rows += group
        found = sorted(((rows[r]["k1"], rows[r]["k2"]), w) for r, w in refined.repeated())
        return span_batch(runs([k for k, _ in found], [w for _, w in found]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[dict]] = []
        held, core = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["core"] != core:
                    if held > SORT_SYMBOLS * 8:
                        yield decide(waiting)
                        waiting, held = [], 0
                    waiting.append([])
                    core = row["core"]
                waiting[-1].append(row)
                held += len(row["raw"])
        if waiting:
            yield decide(waiting)

    return cut.repartition("core").sortWithinPartitions("core").mapInArrow(run, SPAN)


def narrowed(cut: DataFrame) -> DataFrame:
    """The snippets, each as the sub-snippets of up to STEP neighbouring windows, whose shared bytes are their core."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                left, low = row["left"], row["left"] - row["windows"] + 1
                for b in range(low // STEP, left // STEP + 1):
                    near, far = max(low, STEP * b), min(left, STEP * b + STEP - 1)
                    at = left - STEP * b
                    raw = row["raw"][left - far : left - near + LENGTH]
                    core = digest(row["raw"][at : at + LENGTH - STEP + 1], seed=(row["core"] + b) % (1 << 64))
                    out.append((core, digest(raw), row["n"], row["k1"], row["k2"], row["start"] + left - far, far - near + 1, far - STEP * b, raw))
            keys = np.array([r[:2] for r in out], dtype=U64).reshape(-1, 2).view(np.int64)
            cols = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), *[pa.array([r[k] for r in out], t) for k, t in zip(range(2, 9), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]]
            yield pa.RecordBatch.from_arrays(cols, names=["core", "snippet", "n", "k1", "k2", "start", "windows", "left", "raw"])

    return cut.mapInArrow(run, "core long, snippet long, n long, k1 long, k2 long, start int, windows int, left int, raw binary")


def counted(cut: DataFrame) -> DataFrame:
    """The same for cores with very many snippets, by counting hashes of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(row["raw"], np.uint8)
                h = rolling(raw, LENGTH)
                n = len(h)
                same = [pa.array(np.full(n, row[k], dtype=np.int64)) for k in ("k1", "k2", "core", "n")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(h.view(np.int64)), pa.array((row["start"] + np.arange(n)).astype(np.int32))], names=["k1", "k2", "core", "n", "window", "start"])

    windows = materialize(cut.mapInArrow(run, "k1 long, k2 long, core long, n long, window long, start int"), "windows")
    again = windows.groupBy("core", "window").agg(F.count("*").alias("c")).where("c > 1").select(F.col("core").alias("c1"), F.col("window").alias("c2"))
    found = windows.where("n = 1").join(again, (F.col("core") == F.col("c1")) & (F.col("window") == F.col("c2")))
    return found.select("k1", "k2", F.col("start").alias("first"), (F.col("start") + LENGTH).alias("end"))


def met(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Stretches of the rows whose snippet occurs more than once."""
    copied = counts.where("c > 1").select(F.col("core").alias("c1"), F.col("snippet").alias("c2"))
    found = rows.join(copied, (F.col("core") == F.col("c1")) & (F.col("snippet") == F.col("c2")))
    return found.select("k1", "k2", F.col("start").alias("first"), (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("end"))


def contested(counts: DataFrame) -> DataFrame:
    """Snippets whose core has others, with their number ``m``."""
    cores = counts.groupBy(F.col("core").alias("c1")).agg(F.count("*").alias("m")).where("m > 1")
    return counts.join(cores, F.col("core") == F.col("c1"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k1, k2, first, end: stretches of bytes covered by repeated windows; they may overlap."""
    rows = materialize(anchor_rows(docs), "anchors")
    counts = materialize(rows.groupBy("core", "snippet").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "start", "windows", "left")).alias("at")), "snippets")
    cut = materialize(snippets(one_of_each(docs, rows), contested(counts).select("core", F.col("c").alias("n"), "m", "at.*")), "cut")
    # cores with very many snippets are split by narrower cores, and equal sub-snippets collapse again
    parts = materialize(narrowed(cut.where(F.col("m") > GROUP)), "parts")
    again = materialize(parts.groupBy("core", "snippet").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min(F.struct("k1", "k2", "start", "windows", "left", "raw")).alias("at")), "sub-snippets")
    narrow = contested(again).select("core", F.greatest("c", "n").alias("n"), "m", "at.*")
    compare = cut.where(F.col("m") <= GROUP).unionByName(narrow.where(F.col("m") <= GROUP)).drop("m")
    return met(rows, counts).unionByName(met(parts, again)).unionByName(compared(compare)).unionByName(counted(narrow.where(F.col("m") > GROUP).drop("m")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans and removed (first:end of each run) of every document."""
    # equal rows share a key: a set holds their spans once
    spans = repeated_spans(docs).groupBy(F.col("k1").alias("s1"), F.col("k2").alias("s2")).agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    spans = spans.select("s1", "s2", F.col("spans.first").alias("firsts"), F.col("spans.end").alias("ends"))
    rows = docs.select("doc_id", *keyed()).join(spans, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select("doc_id", "text", "firsts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, limit=HASH_CHARS, most=256):
            out: list[tuple] = []
            for doc_id, text, firsts, ends in zip(column(batch, "doc_id").to_pylist(), texts, column(batch, "firsts").to_pylist(), column(batch, "ends").to_pylist(), strict=True):
                raw = text.encode()
                removed: list[list[int]] = []
                for a, b in sorted(zip(firsts or [], ends or [], strict=True)):
                    if removed and a <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], b)
                    else:
                        removed.append([a, b])
                edges = [0, *[x for r in removed for x in r], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, kept, len(raw), len(raw) - len(kept), len(removed), ",".join(f"{a}:{b}" for a, b in removed)))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "removed"])

    return rows.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, removed string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
