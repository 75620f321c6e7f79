"""Best-fit packing of tokenised documents into sequences.

Texts are tokenised in Arrow batches and cut into pieces. Only the histogram of piece lengths (as many entries as a sequence has tokens)
reaches the driver, which runs best-fit decreasing on it: a segment tree over the remaining capacities finds the tightest
open bin in logarithmic time, and equal pieces go in by runs, exactly as one by one. The runs come back as a table of bounded size, and each
piece finds its place by its length and its rank among equal lengths. Ranks come from counts by (length, shard) and their running
sums, so no task holds all pieces of a length.

Defined cases: a null text counts as empty, so it has the end mark alone; ids are carried and never used as keys, so null ids and repeated rows
are pieces like others; an empty table gives an empty result; very long texts are cut into full pieces and a rest; ties among equal
lengths are broken by the order in which pieces were stored; other columns do not matter.
"""

from __future__ import annotations

import json
import re
import struct
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, forget, materialize, text_chunks

SEQUENCE, END_ID = 4096, 1
#: Shards that pieces of one length are ranked in.
SHARDS = 1024
#: Distinct words whose ids a task keeps before the older half is dropped.
CACHE_WORDS = 400_000
#: The normaliser and the splitter for which a text's ids are those of its words. Files with others go to the tokenizer whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_encoders: dict[str, WordEncoder] = {}
_lock = threading.Lock()


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    A tokenizer with the normaliser and splitter above drops white space and never joins across it, so a text's ids are those of its words (``by_words``). Words between ASCII white space are kept in
    a bounded cache; the pieces of a new word of printable ASCII, or of plain Latin letters (with marks at its end), go straight to the vocabulary's merges, any
    other word to the whole tokenizer. Pieces of ASCII are cut as SPLITTER says (``by_pieces``: no added token can be among them).
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.to_str())
        self.by_words = stated["normalizer"] == NORMALIZER and stated["pre_tokenizer"] == SPLITTER and stated["post_processor"] is None
        self.by_pieces = all(t["content"].startswith("<|") for t in stated["added_tokens"])
        self.ascii = re.compile(rb"[!-~]+").fullmatch
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
        self.short: dict[str, bytes] = {}
        self.plain = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
        self.symbols = byte_symbols()
        self.tokenize = self.tokenizer.model.tokenize
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Drop the cache: workers outlive stages, and the next operator needs the memory."""
        self.young, self.old = {}, {}

    def pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, piece: str) -> bytes:
        return self.pack([t.id for t in self.tokenize("".join(self.symbols[b] for b in piece.encode()))])

    def pieced(self, piece: str) -> bytes:
        """Ids of a piece of printable ASCII, whose bytes stand for themselves; those of at most two symbols are kept."""
        if len(piece) > 2:
            return self.pack([t.id for t in self.tokenize(piece)])
        found = self.short.get(piece)
        if found is None:
            found = self.short[piece] = self.merged(piece)
        return found

    def word(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            text = word.decode()
            if self.by_pieces and self.ascii(word):
                low = text.lower()
                found = self.pieced(low) if low.isalpha() else b"".join(map(self.pieced, self.cut(low)))
            elif m := self.plain.fullmatch(text):
                found = self.merged(m[1].lower()) + (self.merged(m[2]) if m[2] else b"")
            else:
                found = self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Special tokens that stand in a text are left to the tokenizer, as they may hold white space in other vocabularies."""
        if not self.by_words or "<|" in text:
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        get, more = self.young.get, self.word
        return b"".join([get(w) or more(w) for w in text.encode().split()])


def encoder(path: str) -> WordEncoder:
    with _lock:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
            forget.append(_encoders[path].forget)
        return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids themselves) of every piece of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch, texts in text_chunks(batches, keep_caches=True):
            rows: list[tuple] = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts, strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at : at + 4 * sequence]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] * with_ids)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            cols = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class CapacityTree:
    """A segment tree over remaining capacities: leaf c holds how many runs of open bins have c tokens left."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = self.leaves + capacity
        while k:
            self.sums[k] += n
            k >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that an open bin has, or -1."""
        k = self.leaves + least
        if not self.sums[k]:
            while k > 1 and (k & 1 or not self.sums[k + 1]):
                k >>= 1
            if k <= 1:
                return -1
            k += 1
            while k < self.leaves:
                k = 2 * k if self.sums[2 * k] else 2 * k + 1
        return k - self.leaves


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Best-fit decreasing of all pieces. Rows: length, first rank, first bin, pieces a bin takes in this run, offset of the first of them.

    The piece of a length with rank r in a run goes to bin ``first bin + (r - first rank) // pieces`` at ``offset + (r - first rank) % pieces * length``.
    """
    tree, runs, rows, bins = CapacityTree(sequence), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                capacity, first = sequence, bins
                n = -(-left // (sequence // length))
                bins += n
            else:
                first, n = runs[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length
            rows.append((length, rank, first, each, sequence - capacity))
            full, part = divmod(min(left, n * each), each)
            put(capacity - each * length, first, full)
            if part:
                put(capacity - part * length, first + full, 1)
            put(capacity, first + full + bool(part), n - full - bool(part))
            rank += full * each + part
            left -= full * each + part
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def sharded(parts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``shard``: rows in turn, so that equal rows spread. It holds once the table is stored."""
    return parts.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))


def pack(parts: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Give each row of a stored table of pieces, dealt to shards by ``sharded`` before it was stored, its sequence_id and offset."""
    spark = parts.sparkSession
    counts = parts.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("b_length"), F.col("shard").alias("b_shard"), F.coalesce("base", F.lit(0)).alias("base"))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).toPandas()
    histogram = dict(zip(lengths["length"].tolist(), lengths["n"].tolist(), strict=True))
    table = plan(histogram, sequence)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)
    ranked = parts.withColumn("place", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("b_length")) & (F.col("shard") == F.col("b_shard"))).withColumn("place", F.col("place") + F.col("base")).drop("b_length", "b_shard", "base", "shard")
    names = [c for c in parts.columns if c != "shard"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields if f.name != "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = (t[:, 0] << 48) | t[:, 1]
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "place").to_numpy()
            row = t[np.searchsorted(key, (length << 48) | rank, side="right") - 1] if len(length) else t[:0]
            bin_, inside = np.divmod(rank - row[:, 1], np.maximum(row[:, 3], 1))
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(row[:, 2] + bin_), pa.array(row[:, 4] + inside * length)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequences; the tokenised lengths are stored once and read twice."""
    return pack(materialize(sharded(pieces(docs, tokenizer, sequence, end_id)), "pieces"), sequence)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
