"""Quality rules: fixed counting rules first, then a hashed n-gram logistic regression trained on labelled rows.

Features of a text are its hashed word uni- and bigrams and character trigrams, square-rooted counts normalised to length 1 in
each half. The regression is fitted on a bounded sample of labelled rows (``max_train``), its probability is calibrated by a
logistic map fitted on a quarter of that sample, and every document is scored in Arrow batches against fixed thresholds.

Defined cases: a null text counts as empty; a text without words fails the base rule; null ids are scored like any other and never
used for training; repeated rows give repeated results, and of a labelled id that occurs more than once one text is learned from, the one with the least hash; an empty table gives an empty result; without labels of both kinds
every document that passes the base rules is kept; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, one_per_id, sample_rank, text_chunks
from .textkernel import U64, Words, code_points, mix, powers, split_words

#: Rows that the regression is fitted on at most, taken in hash order of their ids.
MAX_TRAIN = 4000
WORD_DIMS = CHAR_DIMS = 2048
DIMS = WORD_DIMS + CHAR_DIMS
#: Fixed thresholds of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, KEEP_AT = 20, 30, 8, 0.5
SYMBOLS = "#*$%&|<>"
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: Words, n: int = WINDOW) -> np.ndarray:
    """For each text, the words inside windows of ``n`` words that the text holds twice or more."""
    h, doc = words.hash, words.doc
    out = np.zeros(words.n_docs, dtype=np.int64)
    size = len(h) - n + 1
    if size <= 0:
        return out
    whole = np.zeros(size, dtype=U64)
    for k in range(n):
        whole += h[k : size + k] * powers(n + 1)[k + 1]
    at = np.flatnonzero(doc[:size] == doc[n - 1 :])
    key = mix(whole[at] + mix(doc[at].astype(U64)))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + n, -1)
    return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=words.n_docs)


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def statistics(texts: list[str], words: Words) -> list[np.ndarray]:
    """The columns of STATS."""
    n = len(texts)
    symbol = np.zeros(128, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    at = np.flatnonzero(symbol[np.minimum(words.points, 127)])
    return [
        np.bincount(words.doc, minlength=n),
        np.bincount(words.doc, weights=words.end - words.start, minlength=n).astype(np.int64),
        np.bincount(np.searchsorted(words.bounds, at, side="right") - 1, minlength=n),
        np.array([dup_lines(t) for t in texts], dtype=np.int64),
        repeat_words(words),
    ]


def features(words: Words) -> np.ndarray:
    """A row of DIMS features for each text."""
    n = words.n_docs
    h, doc, p = words.hash, words.doc.astype(np.int64), words.points
    pair = mix(h[:-1] * powers(2)[1] + h[1:])[doc[:-1] == doc[1:]] if len(h) > 1 else h[:0]
    cell = np.concatenate([doc * WORD_DIMS + (h % U64(WORD_DIMS)).astype(np.int64), doc[:-1][doc[:-1] == doc[1:]] * WORD_DIMS + (pair % U64(WORD_DIMS)).astype(np.int64)]) if len(h) else doc
    by_word = np.bincount(cell, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    length = np.diff(words.bounds)
    owner = np.repeat(np.arange(n), length)
    q = p.astype(U64)
    gram = mix((q[:-2] << U64(42)) | (q[1:-1] << U64(21)) | q[2:]) if len(q) > 2 else q[:0]
    inside = owner[: len(gram)] == owner[2:] if len(gram) else np.zeros(0, bool)
    by_char = np.bincount(owner[: len(gram)][inside] * CHAR_DIMS + (gram[inside] % U64(CHAR_DIMS)).astype(np.int64), minlength=n * CHAR_DIMS).reshape(n, CHAR_DIMS)
    out = np.empty((n, DIMS), dtype=np.float32)
    for block, counts in ((slice(0, WORD_DIMS), by_word), (slice(WORD_DIMS, DIMS), by_char)):
        norm = np.sqrt(np.maximum(counts.sum(axis=1, keepdims=True), 1))
        out[:, block] = np.sqrt(counts, dtype=np.float32) / norm
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Balanced logistic regression by accelerated gradient steps."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(x.dtype)
    w = v = np.zeros(x.shape[1], dtype=x.dtype)
    b = c = 0.0
    for k in range(1, steps + 1):
        g = ((1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y) * weight).astype(x.dtype)
        w_new, b_new = (v - rate * (g @ x + l2 * v)).astype(x.dtype), c - rate * float(g.sum())
        t = (k - 1) / (k + 2)
        v, c = (w_new + t * (w_new - w)).astype(x.dtype), b_new + t * (b_new - b)
        w, b = w_new, b_new
    return w, b


def fit_platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the calibrated probability, by damped Newton steps on smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.std(score)), 1e-9)
    s = np.stack([score / scale, np.ones_like(score)], axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(s @ a, -30, 30)))
        a = a - np.linalg.solve(s.T @ (s * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), s.T @ (p - target) + 1e-3 * (a - [1.0, 0.0]))
    return float(a[0] / scale), float(a[1])


def labelled_sample(labels: DataFrame, label: str, limit: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled ids in hash order; an id with both labels counts as 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("sample_id")).agg(F.min(label).cast("int").alias("sample_label"))
    return known.orderBy(sample_rank(F.col("sample_id"), seed), "sample_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, seed: int = 7) -> dict | None:
    """Weights of the regression, or None where the labels lack one of the kinds. Reads at most ``max_train`` labelled texts."""
    picked = docs.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, label, max_train, seed)), F.col("doc_id") == F.col("sample_id")).select("doc_id", "text", "sample_label")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            x = features(split_words(texts))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "sample_label"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = one_per_id(picked, "doc_id", "sample_label").mapInArrow(vectors, "doc_id long, y int, x binary").toPandas().sort_values("doc_id")
    if rows["y"].nunique() < 2:
        return None
    packed, y, ids = rows["x"].tolist(), rows["y"].to_numpy(), rows["doc_id"].to_numpy().astype(np.int64)
    del rows
    apart = mix(ids.view(U64) + U64(seed)) % U64(4) == 0
    if min(len(set(y[apart])), len(set(y[~apart]))) < 2:
        apart[:] = False
    w, b = fit_logistic(matrix(packed, ~apart), y[~apart])
    at = apart if apart.any() else ~apart
    slope, offset = fit_platt(matrix(packed, at) @ w + b, y[at])
    return {"w": (w * slope).astype(np.float32), "b": b * slope + offset}


def matrix(packed: list[bytes], at: np.ndarray) -> np.ndarray:
    """The rows marked by ``at``, unpacked one by one: the driver holds one matrix of them and no copies."""
    where = np.flatnonzero(at)
    out = np.empty((len(where), DIMS), dtype=np.float32)
    for k, i in enumerate(where.tolist()):
        out[k] = np.frombuffer(packed[i], np.float16)
    return out


def probabilities(words: Words, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(words) @ model["w"] + model["b"], -30, 30)))


def judge(docs: DataFrame, model: dict | None, keep_columns: list[str] | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: ``keep_columns`` of the input (all by default), the statistics, base_failed, probability and kept.

    Columns of the input that have the name of an added one give way to it.
    """
    names = [n for n in docs.columns if n not in ADDED] if keep_columns is None else keep_columns
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*names, "text"])])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in text_chunks(batches):
            words = split_words(texts, *code_points(texts))
            stats = statistics(texts, words)
            failed = (stats[0] < MIN_WORDS) | (100 * stats[4] > MAX_REPEAT_PERCENT * stats[0])
            p = probabilities(words, m) if m else np.ones(len(texts))
            out = [column(batch, n) for n in names] + [pa.array(s, pa.int64()) for s in stats]
            out += [pa.array(failed), pa.array(p.astype(np.float64)), pa.array(~failed & (p >= keep_at))]
            yield pa.RecordBatch.from_arrays(out, names=[*names, *ADDED])

    return source.mapInArrow(run, f"{schema}, {STATS}, base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    model = train(docs, labels)
    names = docs.columns
    plain = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") if n not in ("doc_id", "text") else F.col(n) for i, n in enumerate(names)])
    judged = judge(plain, model)
    return judged.where("kept").select(*[F.col(p).alias(n) for p, n in zip(plain.columns, names, strict=True)])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, train(docs, labels), ["doc_id"])
