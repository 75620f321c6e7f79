"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Words are split where letters, digits and marks meet. Each falls into one of BUCKETS hash buckets, whose index vector has a few
+1 and -1 drawn from its number. A pass over all documents adds up, for each bucket, the index vectors of the words within two
places (a table of fixed size, summed by Spark). A word's vector is its context sum and its index vector, each normalised. A text is
the mean of its word vectors, their frequency-damped mean, and the mean product of neighbouring vectors. A network with one
hidden layer is fitted on a bounded sample of labelled rows outside the held-out fold; a temperature fitted on a part of that
sample calibrates its probabilities.

Defined cases: a null text counts as empty and gets the score of an empty text; null ids are scored and never used for training;
repeated rows give repeated results, and of a labelled id that occurs more than once the network learns one text, the one with the least hash; an empty table gives an empty result; without labels of both kinds every score is the
share of label 1 (0.5 if there is none); other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fold, one_per_id, text_chunks
from .quality_rules import labelled_sample
from .textkernel import GOLDEN, U64, code_points, mix, powers

BUCKETS, DIM, MARKS, REACH = 8192, 48, 6, 2
#: Rows that the network is fitted on at most, taken in hash order of their ids.
MAX_TRAIN = 6000
HIDDEN = 32


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each bucket."""
    b = np.arange(BUCKETS, dtype=U64)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    for k in range(MARKS):
        z = mix(b * U64(MARKS) + U64(k) + GOLDEN)
        out[np.arange(BUCKETS), (z >> U64(1)).astype(np.int64) % DIM] += np.where(z & U64(1), 1, -1)
    return out


_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """For each code point: 0 separates words, 1 letter, 2 digit, 3 mark."""
    global _kinds
    if _kinds is None:
        out = np.full(0x110000, 3, dtype=np.uint8)
        out[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
        out[[c for c in range(0x110000) if chr(c).isdecimal()]] = 2
        out[[32, *range(9, 14)]] = 0
        _kinds = out
    return _kinds


def bucketed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, first word of each text and the end)."""
    points, bounds = code_points(texts)
    kind = kinds()[points]
    begin = np.flatnonzero((kind > 0) & (kind != np.concatenate([[0], kind[:-1]])))
    if not len(begin):
        return begin, np.zeros(len(texts) + 1, dtype=np.int64)
    end = np.flatnonzero((kind > 0) & (kind != np.concatenate([kind[1:], [0]]))) + 1
    length = end - begin
    chars = mix(points[kind > 0].astype(U64) + GOLDEN)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    hashed = mix(np.add.reduceat(chars * powers(int(length.max()))[np.arange(len(chars)) - np.repeat(first, length)], first) + length.astype(U64))
    return (hashed % U64(BUCKETS)).astype(np.int64), np.searchsorted(begin, bounds)


def context_sums(slices: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(context sums, word counts) of all buckets over slices of texts."""
    index = index_vectors().astype(np.int8)
    total, seen = np.zeros((BUCKETS, DIM), dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for texts in slices:
        b, first = bucketed(texts)
        if not len(b):
            continue
        # rows of zeros between texts keep their words apart; sums of four entries of MARKS at most fit 8 bits
        at = np.arange(len(b)) + REACH * np.repeat(np.arange(len(texts)), np.diff(first))
        own = np.zeros((len(b) + REACH * len(texts), DIM), dtype=np.int8)
        own[at] = index[b]
        around = np.zeros_like(own)
        for k in range(1, REACH + 1):
            around[k:] += own[:-k]
            around[:-k] += own[k:]
        order = np.argsort(b.astype(np.uint16), kind="stable")
        ranked = b[order]
        begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        total[ranked[begin]] += np.add.reduceat(around[at[order]], begin, axis=0, dtype=np.int32)
        seen += np.bincount(b, minlength=BUCKETS)
    return total, seen


def context_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(context sums, word counts) of all buckets, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = context_sums(texts for _, texts in text_chunks(batches))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used]), *[pa.array(total[used, k]) for k in range(DIM)]], names=["bucket", "seen", *[f"v{k}" for k in range(DIM)]])

    columns = ["seen", *[f"v{k}" for k in range(DIM)]]
    parts = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    rows = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    total, seen = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    at = rows["bucket"].to_numpy().astype(np.int64)
    total[at], seen[at] = rows[columns[1:]].to_numpy(), rows["seen"].to_numpy()
    return total, seen


def word_vectors(total: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, weight) of each bucket; contexts are centred, so that what all words share does not matter."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    share = seen / max(seen.sum(), 1)
    rate = total / np.maximum(seen, 1)[:, None]
    vectors = unit(rate - share @ rate) + unit(index_vectors())
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The features of each text; zeros for a text without words."""
    b, first = bucketed(texts)
    out = np.zeros((len(texts), 3 * DIM + 1), dtype=np.float32)
    count = np.diff(first)
    full = np.flatnonzero(count)
    if len(full):
        v, at = vectors[b], first[:-1][full]
        w = weight[b][:, None]
        n = count[full][:, None].astype(np.float32)
        out[full, :DIM] = np.add.reduceat(v, at, axis=0) / n
        out[full, DIM : 2 * DIM] = np.add.reduceat(v * w, at, axis=0) / np.add.reduceat(w, at, axis=0)
        pair = v.copy()
        pair[:-1] *= v[1:]
        pair[first[1:][full] - 1] = 0
        out[full, 2 * DIM : 3 * DIM] = np.add.reduceat(pair, at, axis=0) / n
        out[full, 3 * DIM] = np.log1p(count[full]) / 5
    return out


def forward(net: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh(((x - net["mean"]) / net["scale"]) @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 11, steps: int = 400, rate: float = 0.01, l2: float = 1e-3) -> dict:
    """Two layers by Adam on the cross-entropy, full batches."""
    rng = np.random.default_rng(seed)
    net = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}
    p = {"w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(())}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    z = (x - net["mean"]) / net["scale"]
    for t in range(1, steps + 1):
        h = np.tanh(z @ p["w1"] + p["b1"])
        d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y) / len(y)
        back = np.outer(d, p["w2"]) * (1 - h * h)
        grads = {"w1": z.T @ back + l2 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ d + l2 * p["w2"], "b2": d.sum()}
        for k, g in grads.items():
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return net | p


def fit_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits, from a fixed grid, with the least cross-entropy."""
    grid = np.geomspace(0.25, 8, 41)
    sign = np.where(y == 1, -1.0, 1.0)
    return float(grid[np.argmin([np.logaddexp(0, sign * logit / t).mean() for t in grid])])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, seed: int = 2) -> dict:
    """Word vectors from all documents, and the network from at most ``max_train`` labelled rows outside the held-out fold."""
    vectors, weight = word_vectors(*context_table(docs))
    shared = docs.sparkSession.sparkContext.broadcast((vectors, weight))
    known = labelled_sample(labels.where(fold(F.col("doc_id")) != 1), label, max_train, seed)
    picked = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("sample_id")).select("doc_id", "text", "sample_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            x = pooled(texts, *shared.value)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "sample_label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = one_per_id(picked, "doc_id", "sample_label").mapInArrow(run, "doc_id long, y int, x binary").toPandas().sort_values("doc_id")
    model = {"vectors": vectors, "weight": weight, "net": None, "share": float(rows["y"].mean()) if len(rows) else 0.5}
    if rows["y"].nunique() < 2:
        return model
    x, y = np.stack([np.frombuffer(r, np.float32) for r in rows["x"]]).astype(np.float64), rows["y"].to_numpy()
    apart = mix(rows["doc_id"].to_numpy().astype(np.int64).view(U64) + U64(seed)) % U64(4) == 0
    if min(len(set(y[apart])), len(set(y[~apart]))) < 2:
        apart[:] = False
    net = fit_network(x[~apart], y[~apart])
    at = apart if apart.any() else ~apart
    return model | {"net": net, "temperature": fit_temperature(forward(net, x[at]), y[at])}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in text_chunks(batches):
            if m["net"] is None:
                p = np.full(len(texts), m["share"])
            else:
                p = 1 / (1 + np.exp(-np.clip(forward(m["net"], pooled(texts, m["vectors"], m["weight"])) / m["temperature"], -30, 30)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", "text", (fold(F.col("doc_id")) == 1).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
