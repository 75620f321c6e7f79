"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text is folded to lower-case letters with single spaces between them. For each language, character 4-grams of all its training texts are counted by Spark; an interpolated Kneser-Ney model of orders 1 to 4 follows. All grams of an order
share one sorted array of hashes beside a matrix of log probabilities (a column for each language), so that one binary search
serves all languages; unseen grams back off. The language with the least cross-entropy per character wins. A logistic map of the margin
to the runner-up, fitted on all texts of a fold that the counts do not use (a quarter of the training ids, unless a language has no others), gives the score; a score under ``reject_below`` sets ``rejected``.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any training text every text is ``und``; null ids are
predicted and never used for training; repeated rows give repeated results, and of a training id that occurs more than once one text is learned from; at
most MAX_LANGUAGES languages are learned, the most frequent ones; an empty table gives an empty result; texts count
whole, whatever their length; ties go to the first language in sorted order; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fold, materialize, one_per_id, text_chunks
from .textkernel import GOLDEN, U64, code_points, mix

ORDER = 4
#: Margins of the calibration fold are counted in bins of this width, in nats.
BIN = 1e-3
#: Distinct grams that a task gathers before it hands their counts on.
HELD_GRAMS = 500_000
REJECT_BELOW = 0.5
#: Languages that are learned at most, the most frequent ones; of the training rows' ids, one in so many calibrates.
MAX_LANGUAGES, CALIBRATES = 200, 4
SPACE = 32
_folds: np.ndarray | None = None


def folds() -> np.ndarray:
    """For each code point: its lower-case letter as 16 bits, or a space if it is no letter."""
    global _folds
    if _folds is None:
        out = np.full(0x110000, SPACE, dtype=np.uint16)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                letter = ord(low[0]) if len(low) == 1 else c
                # letters beyond 16 bits share the private use area
                out[c] = letter if letter < 0x10000 else 0xE000 + letter % 6400
        _folds = out
    return _folds


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed 4-gram that ends at each symbol, text number of each symbol, whether each text has a letter)."""
    points, bounds = code_points(texts)
    symbol = folds()[points]
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    letter = symbol != SPACE
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter | np.concatenate([[False], letter[:-1]])
    s, owner = symbol[keep].astype(U64), owner[keep]
    packed = s.copy()
    for k in range(1, ORDER):
        before = np.full(len(s), SPACE, dtype=U64)
        before[k:] = np.where(owner[k:] == owner[:-k], s[:-k], U64(SPACE))
        packed |= before << U64(16 * k)
    return packed, owner, lettered


def hashed(keys: np.ndarray, order: int) -> np.ndarray:
    return mix(keys ^ mix(np.full(1, order, dtype=U64) * GOLDEN))


def suffix(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of packed grams."""
    return keys if order >= 4 else keys & U64((1 << (16 * order)) - 1)


def find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(among, keys), max(len(among) - 1, 0))
    return at, (among[at] == keys if len(among) else np.zeros(len(keys), bool))


def kneser_ney(counts: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """Sorted hash arrays of orders 1 to 4 with log probabilities and of contexts with log back-off weights, a column for each language.

    ``counts``: for each language its packed 4-grams and their counts.
    """
    n = len(counts)
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for keys, count in counts:
        own = {ORDER: (keys, count.astype(np.float64))}
        for k in range(ORDER - 1, 0, -1):
            low, kinds_before = np.unique(suffix(own[k + 1][0], k), return_counts=True)
            own[k] = (low, kinds_before.astype(np.float64))
        tables.append([own[k] for k in range(1, ORDER + 1)])
    model: dict = {"gram": [], "p": [], "context": [], "back": []}
    symbols = len(np.unique(np.concatenate([t[0][0] for t in tables]))) + 1
    below_keys, below = np.zeros(1, dtype=U64), np.full((1, n), 1.0 / symbols)
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([t[k - 1][0] for t in tables]))
        contexts = np.unique(union >> U64(16))
        p, back = np.zeros((len(union), n)), np.ones((len(contexts), n))
        lower = below[np.searchsorted(below_keys, suffix(union, k - 1) if k > 1 else np.zeros(len(union), U64))]
        where = np.searchsorted(contexts, union >> U64(16))
        for j, t in enumerate(tables):
            keys, count = t[k - 1]
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
            at = np.searchsorted(contexts, keys >> U64(16))
            total = np.bincount(at, weights=count, minlength=len(contexts))
            types = np.bincount(at, minlength=len(contexts))
            back[:, j] = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            place, has = find(keys, union)
            p[:, j] = np.where(has, np.maximum(count[place] - discount, 0), 0) / np.maximum(total[where], 1) + back[where, j] * lower[:, j]
        for name, keys, values, order in (("gram", union, p, k), ("context", contexts, back, k - 1)):
            h = hashed(keys, order)
            by = np.argsort(h)
            model[name].append(h[by])
            model["p" if name == "gram" else "back"].append(np.log(values[by]).astype(np.float32))
        below_keys, below = union, p
    model["none"] = float(np.log(1.0 / symbols))
    return model


def entropies(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per symbol of each text and language, whether the text has a letter)."""
    packed, owner, lettered = grams(texts)
    total = np.zeros((len(packed), model["p"][0].shape[1]), dtype=np.float32)
    open_ = np.arange(len(packed))
    for k in range(ORDER, 0, -1):
        keys = suffix(packed[open_], k)
        at, has = find(model["gram"][k - 1], hashed(keys, k))
        total[open_[has]] += model["p"][k - 1][at[has]]
        open_, keys = open_[~has], keys[~has]
        if not len(open_):
            break
        at, has = find(model["context"][k - 1], hashed(keys >> U64(16), k - 1))
        total[open_[has]] += model["back"][k - 1][at[has]]
    total[open_] += model["none"]
    out = np.zeros((len(texts), total.shape[1]))
    count = np.bincount(owner, minlength=len(texts))
    full = np.flatnonzero(count)
    if len(full):
        first = np.concatenate([[0], np.cumsum(count)[:-1]])[full]
        out[full] = -np.add.reduceat(total, first, axis=0, dtype=np.float64) / count[full][:, None]
    return out, lettered


def margins(entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the best column, how far the next one is behind; 1 nat if there is no other)."""
    best = entropy.argmin(axis=1)
    if entropy.shape[1] < 2:
        return best, np.ones(len(entropy))
    two = np.partition(entropy, 1, axis=1)
    return best, two[:, 1] - two[:, 0]


def fit_confidence(margin: np.ndarray, right: np.ndarray, weight: np.ndarray | None = None, steps: int = 60) -> tuple[float, float]:
    """Logistic map of the margin, by damped Newton steps with a prior that a margin of 0 is a coin's toss. Rows count ``weight`` times."""
    a, prior = np.array([8.0, 0.0]), np.array([8.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    n = np.ones_like(margin) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        a = a - np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 0.05 * np.eye(2), x.T @ (n * (p - right)) + 0.05 * (a - prior))
    return float(a[0]), float(a[1])


def trainable(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and ``calibrates`` of the rows outside the held-out fold that have all three."""
    known = docs.where((fold(F.col("doc_id")) != 1) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return known.select("doc_id", "text", "lang", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(CALIBRATES)) == 0).alias("calibrates"))


def learned(docs: DataFrame) -> DataFrame:
    """The training rows, an id once: only rows of ids that repeat are grouped, the texts of all others stay where they are."""
    known = trainable(docs)
    # stored, so that its size is known when the joins are planned
    repeated = materialize(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    again = one_per_id(known.join(repeated, "doc_id", "left_semi"), "doc_id", "lang", "calibrates")
    return known.join(repeated, "doc_id", "left_anti").unionByName(again)


def train(docs: DataFrame) -> dict | None:
    """The model of the languages that the training rows hold, or None if they hold none."""
    spark = docs.sparkSession
    known = learned(docs)
    seen = known.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("calibrates")).alias("counted"))
    names = seen.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).toPandas()
    if not len(names):
        return None
    # all rows of a rare language may fall to calibration
    rare = names["lang"][names["counted"] == 0].tolist()
    counts_for = ~F.col("calibrates") | F.col("lang").isin(rare)
    known = known.where(F.col("lang").isin(names["lang"].tolist()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merge() -> int:
            for lang, parts in held.items():
                if len(parts) > 1:
                    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                    held[lang] = [(keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64))]
            return sum(len(k) for parts in held.values() for k, _ in parts)

        def handed() -> Iterator[pa.RecordBatch]:
            merge()
            for lang, [(keys, n)] in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch, texts in text_chunks(batches):
            packed, owner, _ = grams(texts)
            kinds, of = np.unique(np.array(column(batch, "lang").to_pylist(), dtype=object), return_inverse=True)
            for j, lang in enumerate(kinds):
                held.setdefault(lang, []).append(np.unique(packed[of[owner] == j], return_counts=True))
                size += len(held[lang][-1][0])
            if size > 2 * HELD_GRAMS and (size := merge()) > HELD_GRAMS:
                yield from handed()
                size = 0
        yield from handed()

    rows = known.where(counts_for).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    langs, counts = [], []
    for lang, own in rows.sort_values(["lang", "gram"]).groupby("lang"):
        keys, n = own["gram"].to_numpy().astype(np.int64).view(U64), own["n"].to_numpy()
        by = np.argsort(keys)
        langs.append(str(lang))
        counts.append((keys[by], n[by]))
    model = kneser_ney(counts) | {"langs": langs}
    shared = spark.sparkContext.broadcast(model)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            entropy, lettered = entropies(texts, shared.value)
            best, margin = margins(entropy)
            right = np.array([shared.value["langs"][b] == x for b, x in zip(best, column(batch, "lang").to_pylist(), strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(margin[lettered] / BIN).astype(np.int64)), pa.array(right[lettered])], names=["bin", "right"])

    tried = known.where("calibrates").select("text", "lang").mapInArrow(test, "bin long, right boolean").groupBy("bin", "right").agg(F.count("*").alias("n")).toPandas().sort_values(["bin", "right"])
    slope, offset = fit_confidence(tried["bin"].to_numpy(dtype=float) * BIN, tried["right"].to_numpy(dtype=float), tried["n"].to_numpy(dtype=float))
    return model | {"slope": max(slope, 0.0), "offset": offset}


def predict(docs: DataFrame, model: dict | None, reject_below: float = REJECT_BELOW) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected and the entropy of the chosen language for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in text_chunks(batches):
            if m is None:
                lang, score, entropy = np.full(len(texts), "und"), np.zeros(len(texts)), np.zeros(len(texts))
            else:
                every, lettered = entropies(texts, m)
                best, margin = margins(every)
                lang = np.where(lettered, np.array(m["langs"])[best], "und")
                score = np.where(lettered, 1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -30, 30))), 0.0)
                entropy = np.where(lettered, every.min(axis=1), 0.0)
            out = [column(batch, "doc_id"), column(batch, "held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(score < reject_below), pa.array(entropy)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "lang_pred", "score", "rejected", "entropy"])

    source = docs.select("doc_id", "text", (fold(F.col("doc_id")) == 1).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, entropy double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
