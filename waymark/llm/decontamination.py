"""Benchmark decontamination: size-partitioned MinHash containment search for short test items inside long documents.

Items are partitioned by the number of their distinct shingles (powers of two). For each partition, documents are cut into windows of shingles
four times its least size, moved by half a window, so an item lies whole inside one window and its Jaccard similarity to that window
stays high however long the document is. Items and windows are sketched by one-permutation MinHash (SKETCHES sketches of REGISTERS
registers); a document is a candidate for an item if any register of any window agrees. Candidates are then decided by the exact share
of the item's shingles that the whole document holds.

Items come in blocks of about BLOCK_SHINGLES shingles (a stated query set against all documents); only one block at a time is on the driver or
broadcast, so the benchmark may grow. Documents stream through Arrow batches and are never shuffled.

Defined cases: null or wordless texts match nothing; an item of one to four words has one shingle of them all and is found only in a document of just these
words; null ids are carried; repeated rows give repeated results, and equal items are searched once; an empty table gives an empty result; texts count whole; other
columns do not matter, and ``drop_leaks`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, plainly, shingles_sql, text_chunks
from .textkernel import GOLDEN, U64, mix, shingles, split_words

WORDS, THRESHOLD = 5, 0.8
SKETCHES, REGISTERS = 3, 256
BLOCK_SHINGLES = 1_000_000
FILTER_BITS = 22


def values(hashes: np.ndarray, sketch: int) -> tuple[np.ndarray, np.ndarray]:
    """(register, rank) of shingles in one sketch; the least rank of a register is its MinHash."""
    h = mix(hashes + U64(int(GOLDEN) * (sketch + 1) % (1 << 64)))
    return (h % U64(REGISTERS)).astype(np.int64), h


def minima(hashes: np.ndarray, sketch: int) -> np.ndarray:
    """The shingles that are the MinHash of their register."""
    register, rank = values(hashes, sketch)
    order = np.lexsort((rank, register))
    return hashes[order[np.concatenate([[True], np.diff(register[order]) != 0])]]


class ItemIndex:
    """Sketches of one block of items, partitioned by size."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        self.partitions: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_size: dict[int, list[int]] = {}
        for number, own in enumerate(items):
            if len(own):
                by_size.setdefault(1 << (len(own).bit_length() - 1), []).append(number)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        for least, numbers in by_size.items():
            tables = []
            for sketch in range(SKETCHES):
                keys = [minima(items[n], sketch) for n in numbers]
                key, owner = np.concatenate(keys), np.repeat(numbers, [len(k) for k in keys])
                order = np.argsort(key)
                tables.append((key[order], owner[order]))
                self.filter[(key & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.partitions[least] = tables

    def candidates(self, own: np.ndarray, hits: np.ndarray) -> set[int]:
        """Items that agree with a register of a window of the document. ``own``: its shingles in order; ``hits``: places that pass the filter."""
        found: set[int] = set()
        for least, tables in self.partitions.items():
            step = 2 * least
            for sketch, (key, owner) in enumerate(tables):
                left, right = np.searchsorted(key, own[hits]), np.searchsorted(key, own[hits], side="right")
                inside = np.flatnonzero(right > left)
                checked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for i in inside.tolist():
                    items = owner[left[i] : right[i]].tolist()
                    if found.issuperset(items):
                        continue
                    place = int(hits[i])
                    for window in {place // step, max(0, place // step - 1)}:
                        if window not in checked:
                            checked[window] = values(own[window * step : window * step + 2 * step], sketch)
                        register, rank = checked[window]
                        at = place - window * step
                        if rank[register == register[at]].min() == rank[at]:
                            found.update(items)
                            break
        return found

    def matches(self, texts: list[str], threshold: float) -> list[tuple[int, int, int]]:
        """(text number, item number, shared shingles) of every item that a text holds."""
        docs, hashes = shingles(split_words(texts), WORDS)
        hit = np.flatnonzero(self.filter[(hashes & U64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if not len(hit):
            return []
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
        hit = np.flatnonzero(self.filter[(hashes & U64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        out = []
        for doc in np.unique(docs[hit]).tolist():
            begin, end = np.searchsorted(docs, doc), np.searchsorted(docs, doc, side="right")
            own = hashes[begin:end]
            candidates = sorted(self.candidates(own, hit[(hit >= begin) & (hit < end)] - begin))
            if candidates:
                distinct = np.unique(own)
                for number in candidates:
                    item = self.items[number]
                    at = np.minimum(np.searchsorted(distinct, item), len(distinct) - 1)
                    shared = int((distinct[at] == item).sum())
                    if shared >= threshold * len(item):
                        out.append((doc, number, shared))
        return out


def item_table(items: DataFrame) -> DataFrame:
    """item_id, shingles (packed and distinct), their number n, and key, a digest of them, of the items that have words; stored."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            docs, hashes = shingles(split_words(texts), WORDS)
            own = [np.unique(hashes[docs == i]) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([column(batch, "item_id"), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())], names=["item_id", "shingles", "n"])

    rows = items.select("item_id", "text").mapInArrow(sketch, "item_id long, shingles binary, n long").where("n > 0")
    return materialize(rows.withColumn("key", F.md5("shingles")), "items")


def item_blocks(table: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Blocks of (keys, distinct shingles of each) of the different items, one at a time; items with the same shingles are searched once."""
    once = materialize(table.groupBy("key").agg(F.first("shingles").alias("shingles"), F.first("n").alias("n")), "different-items")
    total = once.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_shingles))
    for b in range(blocks):
        part = once.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b) if blocks > 1 else once
        rows = part.orderBy("key").collect()
        if rows:
            yield [r["key"] for r in rows], [np.frombuffer(r["shingles"], U64) for r in rows]


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every (document, item) with containment of ``threshold`` or more."""
    out = None
    schema = "doc_id long, key string, n_shared long, n_item long, containment double"
    table = item_table(items)
    for keys, own in item_blocks(table):
        shared = docs.sparkSession.sparkContext.broadcast((keys, own))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, items = shared.value
            index = ItemIndex(items)
            for batch, texts in text_chunks(batches):
                doc_ids = column(batch, "doc_id").to_pylist()
                rows = [(doc_ids[d], names[i], n, len(items[i]), n / len(items[i])) for d, i, n in index.matches(texts, threshold)]
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_shared", "n_item", "containment"])

        found = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    out = docs.sparkSession.createDataFrame([], schema) if out is None else out
    return out.join(table.select("key", "item_id"), "key").select("doc_id", "item_id", "n_shared", "n_item", "containment")


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    for _, own in item_blocks(item_table(items)):
        shared = docs.sparkSession.sparkContext.broadcast(own)
        plain, back = plainly(docs)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value)
            for batch, texts in text_chunks(batches):
                keep = np.ones(len(texts), dtype=bool)
                keep[[d for d, *_ in index.matches(texts, threshold)]] = False
                if keep.any():
                    yield batch.filter(pa.array(keep))

        docs = back(plain.mapInArrow(clean, plain.schema))
    return docs


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The exact containment of every item in every document.
LEAKS_SQL = f"""
WITH d AS ({shingles_sql('documents', 'doc_id')}), i AS ({shingles_sql('benchmark', 'item_id')}), n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment FROM s JOIN n USING (item_id) WHERE n_shared >= {THRESHOLD} * n_item"""
