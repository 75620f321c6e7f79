"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text's weighted shingles (five words, weight: how often) give REGISTERS ProbMinHash components: every shingle is a Poisson process with its
weight as rate, whose arrivals fall on registers at random; only arrivals before a stop time that fills all registers are generated. Two texts
agree in a register with the chance of their probability Jaccard similarity, which is the Jaccard similarity if no shingle repeats. BANDS bands of ROWS
registers propose pairs; a pair is a link if the exact Jaccard similarity of its sets of shingles is THRESHOLD or more. Classes are the
connected components of links. As links do not ask how often a shingle occurs, a text that repeats shingles also has the bands of its set (all weights 1) in
the same buckets; a text without repeats has the same bands either way.

Texts with the same words are one content (a 128-bit digest), so copies never meet in a bucket. In each bucket contents are paired with a few pivots only:
first each content with the least one it meets, then, where a bucket still holds several classes, with PIVOTS contents drawn by hashes. Only contents of other
classes count, and only those whose sizes and parity bits allow a link. This emits no more than PIVOTS rows a member. Buckets whose contents
still lie in different classes go to an exact prefix join: shingles are ordered from rare to common (by counts in hashed bins of fixed number), and two
contents can only reach the threshold if the first shingle they share comes early in both. What is left there are pairs of
different classes close to the threshold. So no bucket emits all its pairs, and no link inside a bucket is lost. A pair of sets of
Jaccard similarity 0.8 misses all buckets with a chance of 3 in a million, whatever repeats.

Defined cases: null and wordless texts are classes of their own; texts of one to four words have one shingle of them all; the class id is the least doc_id of the
class (null ids count as the lowest, -1, among themselves); repeated rows share a class, and ``keep_one`` keeps one of them; an empty
table gives an empty result; texts count whole; other columns do not matter, and ``keep_one`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, discard, materialize, plainly, shingles_sql, text_chunks
from .textkernel import GOLDEN, U64, Words, mix, shingles, split_words

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Hashed bins in which shingles are counted to tell common from rare ones.
COUNT_BINS = 1 << 18
#: Pivots of a bucket, drawn by hashes, before the exact join.
PIVOTS = 4
#: Tables of up to so many rows of two digests (10 MB) are broadcast in joins on keys that one class may hold.
BROADCAST_ROWS = 200_000
#: Words of parity bits that tell apart sets which share too little.
BIT_WORDS = 16
BITS = [f"bits{k}" for k in range(BIT_WORDS)]
#: Expected arrivals at a register before the first stop time; texts with an empty register go on to twice the time.
ARRIVALS = float(np.log(REGISTERS)) + 3.0


def golden(k: int) -> np.uint64:
    return U64(int(GOLDEN) * k % (1 << 64))


def weighted_shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, weight) of distinct shingles, sorted by text and hash."""
    docs, hashes = shingles(words, WORDS)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    if not len(docs):
        return docs, hashes, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])]))
    return docs[at], hashes[at], np.diff(np.append(at, len(docs)))


def prob_min_hash(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of texts with shingles, their registers): the shingle of the first arrival at each register."""
    present, owner = np.unique(docs, return_inverse=True)
    rate = np.bincount(owner, weights=weights, minlength=len(present))
    out = np.zeros((len(present), REGISTERS), dtype=U64)
    stop = REGISTERS * ARRIVALS / np.maximum(rate, 1e-300)
    todo = np.ones(len(present), dtype=bool)
    while todo.any():
        at = np.flatnonzero(todo[owner])
        h, own, w = hashes[at], owner[at], weights[at]
        time = np.zeros(len(at))
        keys, times, marks = [], [], []
        k = 0
        while len(at):
            draw = mix(h ^ golden(2 * k + 1))
            time = time - np.log((draw >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / w
            live = time < stop[own]
            h, own, w, time = h[live], own[live], w[live], time[live]
            at = at[live]
            register = (mix(h + golden(2 * k + 2)) % U64(REGISTERS)).astype(np.int64)
            keys.append(own * REGISTERS + register)
            times.append(time)
            marks.append(h)
            k += 1
        key, when, mark = np.concatenate(keys), np.concatenate(times), np.concatenate(marks)
        order = np.lexsort((when, key))
        key, mark = key[order], mark[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        out.reshape(-1)[key[first]] = mark[first]
        filled = np.bincount(key[first] // REGISTERS, minlength=len(present))
        todo &= filled < REGISTERS
        stop[todo] *= 2
    return present, out


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted hashes, which ``prob_min_hash`` estimates."""
    at = np.minimum(np.searchsorted(ha, hb), max(len(ha) - 1, 0))
    both = ha[at] == hb if len(ha) else np.zeros(len(hb), bool)
    if not both.any():
        return 0.0
    a, b = wa[at[both]].astype(float), wb[both].astype(float)
    ratio = b / a
    only_a, only_b = float(wa.sum() - a.sum()), float(wb.sum() - b.sum())
    order = np.argsort(ratio)
    levels, first = np.unique(ratio[order], return_index=True)
    below = np.add.reduceat(a[order], first)
    above = np.add.reduceat(b[order], first)
    whole = only_a + np.cumsum(below) + (only_b + above.sum() - np.cumsum(above)) / levels
    return float((below / whole).sum())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets as sorted hashes."""
    if not len(a) or not len(b):
        return 0.0
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return shared / (len(a) + len(b) - shared)


def digest(words: Words) -> list[bytes | None]:
    """A 128-bit digest of each text's words in order, or None without words."""
    count = np.bincount(words.doc, minlength=words.n_docs)
    ends = np.cumsum(count)
    raw = words.hash.tobytes()
    return [hashlib.blake2b(raw[8 * (e - c) : 8 * e], digest_size=16).digest() if c else None for c, e in zip(count.tolist(), ends.tolist(), strict=True)]


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A hash of each band with its number, for each row of registers."""
    bands = np.zeros((len(registers), BANDS), dtype=U64) + mix(np.arange(1, BANDS + 1, dtype=U64))
    for r in range(ROWS):
        bands = mix(bands + registers[:, r::ROWS] + golden(r + 1))
    return bands


def bands_of(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int) -> list[np.ndarray | None]:
    """The distinct band keys of each text with shingles: by its counts and, if a shingle repeats, by its set too."""
    present, registers = prob_min_hash(docs, hashes, weights, n_docs)
    out: list[np.ndarray | None] = [None] * n_docs
    for i, keys in zip(present.tolist(), band_keys(registers), strict=True):
        out[i] = keys.view(np.int64)
    repeats = np.zeros(n_docs, bool)
    repeats[docs[weights > 1]] = True
    kept = repeats[docs]
    if not kept.any():
        return out
    present, registers = prob_min_hash(docs[kept], hashes[kept], np.ones(int(kept.sum()), np.int64), n_docs)
    for i, keys in zip(present.tolist(), band_keys(registers), strict=True):
        out[i] = np.unique(np.concatenate([out[i], keys.view(np.int64)]))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, cid (content digest) and bands (the keys of its buckets) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, most=256):
            words = split_words(texts)
            cids = digest(words)
            first = {c: i for i, c in reversed(list(enumerate(cids))) if c}
            lead = np.zeros(len(texts), bool)
            lead[list(first.values())] = True
            own, hashes, weights = weighted_shingles(words)
            kept = lead[own]
            rows = bands_of(own[kept], hashes[kept], weights[kept], len(texts))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(cids, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "cid", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, cid binary, bands array<long>")


def parity(hashes: np.ndarray) -> np.ndarray:
    """BIT_WORDS words: for each of 64 * BIT_WORDS bins of hashes, whether the set has an odd number there."""
    return np.packbits(np.bincount((hashes % U64(64 * BIT_WORDS)).astype(np.int64), minlength=64 * BIT_WORDS) % 2 == 1).view(np.int64)


SETS = "cid binary, hashes binary, n int, " + ", ".join(f"{b} long" for b in BITS)


def shingle_rows(docs: DataFrame) -> DataFrame:
    """cid, hashes (a packed sorted array of distinct shingles), their number n and the parity words BITS of texts that ``docs`` gives with their cid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, most=256):
            own, hashes, _ = weighted_shingles(split_words(texts))
            bounds = np.searchsorted(own, np.arange(len(texts) + 1))
            sets = [hashes[begin:end] for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            bits = np.stack([parity(x) for x in sets])
            cols = [column(batch, "cid"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(np.diff(bounds).astype(np.int32)), *[pa.array(bits[:, k]) for k in range(BIT_WORDS)]]
            yield pa.RecordBatch.from_arrays(cols, names=["cid", "hashes", "n", *BITS])

    return docs.select("cid", "text").mapInArrow(run, SETS)


def sharing_needed(n_u: Column, n_v: Column, threshold: float) -> Column:
    """How many shingles sets of these sizes share at least if their Jaccard similarity is ``threshold``."""
    return (n_u + n_v) * (threshold / (1 + threshold)) - 1e-6


def similar_parity(u: str, v: str, threshold: float) -> Column:
    """Whether sizes and parity words, columns named with the suffixes ``u`` and ``v``, allow a link.

    A shingle in one set only flips one bit, so differing bits count no more than such shingles, n + m - 2 * shared at most.
    """
    n_u, n_v = F.col(f"n_{u}"), F.col(f"n_{v}")
    flipped = F.lit(0)
    for bits in BITS:
        flipped = flipped + F.bit_count(F.col(f"{bits}_{u}").bitwiseXOR(F.col(f"{bits}_{v}")))
    needed = sharing_needed(n_u, n_v, threshold)
    return (F.least(n_u, n_v) >= needed) & (flipped <= n_u + n_v - 2 * needed)


def possible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sizes and parity words allow a link."""
    for x in "uv":
        pairs = pairs.join(sets.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *BITS)]), x)
    return pairs.where(similar_parity("u", "v", threshold)).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of contents whose exact Jaccard similarity is ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # values one at a time: sets of long texts are large
            good = [jaccard(*(np.frombuffer(x.as_py(), U64) for x in pair)) >= threshold for pair in zip(column(batch, "uh"), column(batch, "vh"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    u, v = (sets.select(F.col("cid").alias(f"{x}_cid"), F.col("hashes").alias(f"{x}h")) for x in "uv")
    rows = pairs.join(u, F.col("u") == F.col("u_cid")).drop("u_cid").join(v, F.col("v") == F.col("v_cid"))
    return rows.select("u", "v", "uh", "vh").mapInArrow(run, "u binary, v binary")


def small(table: DataFrame) -> DataFrame:
    """The stored table, marked for broadcast if it has BROADCAST_ROWS rows at most. Larger ones go to sort-merge joins, whose hot keys adaptive execution splits."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(cid, label): least contents of the connected components that ``edges`` (u, v) make of the classes in ``labels``.

    Each round takes the least label among neighbours and then the label's own label, as stored tables, until nothing changes. Joins on what many
    rows share, a hub or the label of a large class, go by ``small``; groups are aggregated before they are shuffled.
    """
    edges = materialize(edges, "edges")
    at = labels.select(F.col("cid").alias("x"), "label")
    linked = edges.join(at.withColumnRenamed("label", "a"), F.col("u") == F.col("x")).drop("x").join(at.withColumnRenamed("label", "b"), F.col("v") == F.col("x")).where(F.col("a") != F.col("b"))
    links = materialize(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("low")), "state")
    old = []
    while True:
        named = small(state.select(F.col("node").alias("n2"), F.col("low").alias("low2")))
        around = both.join(named, F.col("b") == F.col("n2")).groupBy(F.col("a").alias("node")).agg(F.min("low2").alias("near"))
        jumped = state.join(named, F.col("low") == F.col("n2")).select("node", "low", F.least("low", "low2").alias("jump"))
        new = materialize(jumped.join(around, "node").select("node", F.least("jump", "near").alias("low"), (F.least("jump", "near") < F.col("low")).alias("moved")), "state")
        old.append(state)
        state = new.select("node", "low")
        if not new.where("moved").limit(1).count():
            break
    renamed = small(state.select(F.col("node").alias("label"), "low"))
    out = materialize(labels.join(renamed, "label", "left").select("cid", F.coalesce("low", "label").alias("label")), "labels")
    discard(edges, links, *old, new)
    return out


def labelled(met: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, cid and label of all members, stored; the same of the buckets whose contents lie in different classes)."""
    rows = materialize(met.select("bucket", "cid").join(labels, "cid"), "labelled")
    mixed = rows.groupBy(F.col("bucket").alias("b")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("b")
    return rows, rows.join(mixed, F.col("bucket") == F.col("b"), "left_semi")


def drawn(rows: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Pairs (u, v) of each bucket's pivots, the first contents by as many hashes, with its contents of other classes. ``rows`` has bucket, cid and label."""
    first = [F.min_by(F.struct("cid", "label"), F.struct(F.xxhash64("cid", F.lit(k)), "cid")) for k in range(pivots)]
    low, high = F.min("label").alias("low"), F.max("label").alias("high")
    heads = rows.groupBy(F.col("bucket").alias("b")).agg(F.array_distinct(F.array(*first)).alias("heads"), low, high).where("low < high").select("b", "heads")
    pairs = rows.join(heads, F.col("bucket") == F.col("b")).select("cid", "label", F.explode("heads").alias("head")).where(F.col("label") != F.col("head.label"))
    return pairs.select(F.least("cid", "head.cid").alias("u"), F.greatest("cid", "head.cid").alias("v")).distinct()


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(cid, shingle, place, n): the rarest shingles of each content, more than 1 - ``threshold`` of them.

    ``place`` counts from 0 in the order of rarity; n and BITS are those of the set.
    """
    spark = sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNT_BINS, dtype=np.int64)
        for batch in batches:
            for h in column(batch, "hashes"):
                np.add.at(seen, (np.frombuffer(h.as_py(), U64) % U64(COUNT_BINS)).astype(np.int64), 1)
        used = np.flatnonzero(seen > 1)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["bin", "n"])

    bins = sets.select("hashes").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    common = np.zeros(COUNT_BINS, dtype=np.int64)
    common[bins["bin"].to_numpy()] = bins["n"].to_numpy()
    shared = spark.sparkContext.broadcast(np.minimum(common, np.iinfo(np.int32).max).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, h, *bits in zip(*(column(batch, n) for n in ("cid", "hashes", *BITS)), strict=True):
                cid, hashes, bits = cid.as_py(), np.frombuffer(h.as_py(), U64), [x.as_py() for x in bits]
                order = np.lexsort((hashes, shared.value[(hashes % U64(COUNT_BINS)).astype(np.int64)]))
                kept = hashes[order][: int((1 - threshold) * len(hashes) + 1e-6) + 1]
                cols = [pa.array([cid] * len(kept), pa.binary()), pa.array(kept.view(np.int64)), pa.array(np.arange(len(kept))), pa.array(np.full(len(kept), len(hashes))), *[pa.array(np.full(len(kept), x)) for x in bits]]
                yield pa.RecordBatch.from_arrays(cols, names=["cid", "shingle", "place", "n", *BITS])

    return sets.select("cid", "hashes", *BITS).mapInArrow(run, "cid binary, shingle long, place long, n long, " + ", ".join(f"{b} long" for b in BITS))


def sharing(rare: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) of contents of different classes that share a rare shingle early enough to reach ``threshold``.

    Sets of n and m shingles with Jaccard t share o = t / (1 + t) * (n + m), so the first shared shingle has at most n - o and m - o
    shingles before it.
    """
    side = lambda x: [F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("label", "place", "n", *BITS)]]
    a, b = rare.select("shingle", *side("u")), rare.select("shingle", *side("v"))
    needed = sharing_needed(F.col("n_u"), F.col("n_v"), threshold)
    early = (F.col("place_u") <= F.col("n_u") - needed) & (F.col("place_v") <= F.col("n_v") - needed)
    apart = (F.col("label_u") != F.col("label_v")) & (F.col("u") < F.col("v"))
    return a.join(b, ["shingle"]).where(apart & early & similar_parity("u", "v", threshold)).select("u", "v").distinct()


def in_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id and cid of every document, cid and label of every content in a class of several contents)."""
    known = materialize(signatures(docs), "signatures")
    names = known.select("doc_id", "cid")
    contents = known.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min(owned()).alias("owner"), F.max("bands").alias("bands"))
    contents = materialize(contents, "contents")
    rows = contents.select("cid", F.explode("bands").alias("bucket"))
    leads = rows.groupBy("bucket").agg(F.min("cid").alias("lead"), F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("b"), "lead")
    met = materialize(rows.join(leads, F.col("bucket") == F.col("b")).select("bucket", "cid", "lead"), "met")
    members = materialize(met.groupBy("cid").agg(F.min("lead").alias("lead")), "members")
    own = members.select("cid").join(contents.select("cid", "owner"), "cid")
    # one stored text for each content that meets another
    keyed = with_content(docs.select("doc_id", "text")).join(own, ["cid", "owner"], "left_semi").select("cid", "text")
    sets = materialize(shingle_rows(keyed).dropDuplicates(["cid"]), "sets")
    labels = materialize(members.select("cid", F.col("cid").alias("label")), "labels")
    pairs = members.where("lead < cid").select(F.col("lead").alias("u"), F.col("cid").alias("v"))
    old, labels = labels, components(labels, verified(possible(pairs, sets, threshold), sets, threshold))
    discard(old)
    rows, _ = labelled(met, labels)
    old, labels = labels, components(labels, verified(possible(drawn(rows), sets, threshold), sets, threshold))
    discard(old, rows)
    rows, open_ = labelled(met, labels)
    rare = materialize(prefixes(sets.join(open_.select("cid").distinct(), "cid", "left_semi"), threshold).join(labels, "cid"), "rare")
    split = rare.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    rest = sharing(rare.join(split, "shingle", "left_semi"), threshold)
    old, labels = labels, components(labels, verified(rest, sets, threshold))
    discard(old, rows, met, rare, sets, members, contents)
    return names, labels


def owned() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-1))


def with_content(docs: DataFrame) -> DataFrame:
    """The rows that have words, with the digest of their content as ``cid`` and their id, or -1, as ``owner``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, most=256):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest(split_words(texts)), pa.binary())], names=[*batch.schema.names, "cid"])

    return docs.mapInArrow(run, f"{fields}, cid binary").withColumn("owner", owned())


def class_table(names: DataFrame, labels: DataFrame) -> DataFrame:
    """cid, class_id (least doc_id) and keeper (the content that holds it) of every content."""
    owners = names.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min(owned()).alias("owner"))
    labelled = owners.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = labelled.groupBy("label").agg(F.min(F.struct("owner", "cid")).alias("best"))
    return labelled.join(least, "label").select("cid", "owner", F.col("best.owner").alias("class_id"), F.col("best.cid").alias("keeper"))


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of every document."""
    names, labels = in_classes(docs, threshold)
    table = class_table(names, labels).select(F.col("cid").alias("c"), "class_id")
    return names.join(table, F.col("cid") == F.col("c"), "left").select("doc_id", F.coalesce("class_id", owned()).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least id, with its own columns; null and wordless texts stay."""
    plain, back = plainly(docs)
    names, labels = in_classes(plain, threshold)
    keepers = class_table(names, labels).where("cid = keeper").select(F.col("owner").alias("k_owner"), F.col("cid").alias("k_cid"))
    rows = with_content(plain)
    full = rows.where(F.col("cid").isNotNull())
    kept = full.join(keepers, (F.col("owner") == F.col("k_owner")) & (F.col("cid") == F.col("k_cid"))).dropDuplicates(["owner", "cid"])
    return back(kept.select(plain.columns).unionByName(rows.where(F.col("cid").isNull()).select(plain.columns)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs by shared shingles, and the components of links.
CLASSES_SQL = f"""
WITH RECURSIVE s AS ({shingles_sql('documents', 'doc_id')}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= {THRESHOLD} * (a.n + b.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id"""
