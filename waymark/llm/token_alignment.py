"""Alignment of two tokenizers' tokens over the bytes of every text, and corpus-wide counts of the id pairs that overlap.

A slice of an Arrow partition is cut into units at spaces between two other characters, where neither tokenizer's tokens reach across: A's splitter starts a new stretch
at such a space, and no piece of B holds its space sign behind another character. So equal units have equal tokens, and each different unit of the slice is tokenised and aligned once.
DuckDB does this with a table of token intervals for each tokenizer: ASOF joins on the ends give the tokens that cover the bytes up to each end of a token. Both tokenizers tile the bytes, so every
overlap is one such stretch, and ASOF joins find what range joins of the intervals would. Ends that both have bound the groups, which window sums number. A join of documents with their units' links gives the id pairs of each document.

What a slice knows of pairs (its different pairs, and in how many of its documents each is linked) is one stored row; Spark adds these up, joins the sums back to slices, and each slice's documents meet
the counts of its own pairs. Nothing of corpus size reaches the driver; the only broadcast is a row for each id of A.

Defined cases: null and empty texts, and texts whose tokens don't spell a space and the text (such as those with U+2581), have no tokens: zeros and ''; null ids are carried and ids are never keys, so repeated
rows count as documents of their own; an empty table gives an empty result; texts count whole, and one without safe spaces is one unit; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, text_chunks
from .packing import byte_symbols

#: Characters of texts that are aligned at once, and units that are tokenised in one call.
SLICE_CHARS, TOGETHER = 3_000_000, 64
#: Ids of B take this many bits of a pair's code.
B_BITS = 15
SPACE_SIGN = "▁"
#: A space beside white space or at an edge of the text.
UNSAFE = re.compile(r"(?:^|\s) | (?:\s|$)")
SAFE = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f"
#: Fixed value: the splitter of byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_tokenizers: dict[tuple[str, str], Tokenizers] = {}


class Tokenizers:
    """Both tokenizers: ids of strings, and the bytes and byte lengths of ids.

    A is a byte-level file; where its ids follow its merges (the usual form), ids come from the same vocabulary as ranks, which is faster. B is a piece model with byte pieces.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        stated = json.loads(self.a.to_str())
        splitter, vocabulary, merges = stated["pre_tokenizer"], stated["model"]["vocab"], stated["model"]["merges"]
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        spelled = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items() if all(c in byte_of for c in t)}
        special = {t["id"] for t in stated["added_tokens"]}
        by_regex = stated["normalizer"] is None and splitter == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        self.ranks = None
        if by_regex and [vocabulary[m] for m in made] == list(range(256, 256 + len(made))):
            import tiktoken

            self.ranks = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={b: i for i, b in spelled.items() if i not in special}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.a_bytes = [spelled.get(i, b"") for i in range(max(vocabulary.values()) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.signs = [f"{i}{x}" for n, xs in ((len(self.a_bytes), ",|"), (len(pieces), ",;")) for i in range(n) for x in xs]
        if len(pieces) > 1 << B_BITS or len(self.a_bytes) > 1 << (31 - B_BITS):
            raise ValueError("vocabularies of up to 65,536 and 32,768 ids only")
        probe = "x  ﬁ é\tＡ "
        plain = b"".join(self.b_bytes[i] for i in self.b.encode(probe)) == b" " + probe.encode()
        self.units_are_safe = by_regex and plain and not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)

    def a_ids(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.ranks else self.a.encode(text, add_special_tokens=False).ids

    def spelled(self, cuts: dict[str, np.ndarray], n_units: int) -> list[str]:
        """The groups of each unit as text, from cuts in the order of bytes: A's ids, a bar, B's ids."""
        a_ends, b_ends = cuts["a_ends"], cuts["b_ends"]
        ga, gb = cuts["g"][a_ends], cuts["g"][b_ends]
        # a token's sign in ``signs``: its id with what follows it, another id of its group or the end of the group's side
        a_last, b_last = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (ga, gb))
        signs = np.zeros(len(ga) + len(gb), dtype=np.int64)
        signs[np.arange(len(ga)) + np.searchsorted(gb, ga)] = 2 * cuts["a"][a_ends] + a_last
        signs[np.arange(len(gb)) + np.searchsorted(ga, gb, side="right")] = 2 * (len(self.a_bytes) + cuts["b"][b_ends]) + b_last
        size = np.bincount(cuts["u"][a_ends], minlength=n_units) + np.bincount(cuts["u"][b_ends], minlength=n_units)
        # units stand in the order of their tokens, which is not that of their numbers
        starts = np.flatnonzero(np.diff(cuts["u"], prepend=-1))
        out, at = [""] * n_units, 0
        sign, listed = self.signs.__getitem__, signs.tolist()
        for u in cuts["u"][starts].tolist():
            end = at + int(size[u])
            out[u] = "".join(map(sign, listed[at:end]))[:-1]
            at = end
        return out

    def units(self, text: str) -> list[str]:
        """The units of a text, without the space before each."""
        if not self.units_are_safe:
            return [text]
        if text.isascii():
            odd = "  " in text or text[0] == " " or text[-1] == " " or any(c in text and (c + " " in text or " " + c in text) for c in OTHER_SPACES)
        else:
            odd = SPACE_SIGN in text or UNSAFE.search(text)
        return SAFE.split(text) if odd else text.split(" ")


def tokenizers_of(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _tokenizers:
        _tokenizers[paths] = Tokenizers(*paths)
    return _tokenizers[paths]


def intervals(both: Tokenizers, units: list[str]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """Tables of A's and B's tokens (unit, id, end in bytes, place) over the units laid end to end, each with a space before it; and which units both spell exactly."""
    # white space at a unit's edge, or a space sign, must not touch another unit
    alone = [u for u, x in enumerate(units) if not x or x[0].isspace() or x[-1].isspace() or SPACE_SIGN in x]
    apart = set(alone)
    rest = [u for u in range(len(units)) if u not in apart]
    width = TOGETHER if both.units_are_safe else 1
    calls = [[u] for u in alone] + [rest[i : i + width] for i in range(0, len(rest), width)]
    good = np.zeros(len(units), dtype=bool)
    a_all, b_all, order = [], [], []
    pending = calls
    while pending:
        again: list[list[int]] = []
        texts = [" ".join([units[u] for u in call]) for call in pending]
        for call, text, b in zip(pending, texts, both.b.encode(texts, num_threads=1), strict=True):
            raw = b" " + text.encode()
            a = both.a_ids(" " + text)
            if b"".join([both.b_bytes[i] for i in b]) == raw and b"".join([both.a_bytes[i] for i in a]) == raw:
                good[call] = True
                order += call
                a_all += a
                b_all += b
            elif len(call) > 1:
                again += [[u] for u in call]
        pending = again
    size = np.array([len(units[u].encode()) + 1 for u in order], dtype=np.int64)
    ends = np.cumsum(size)
    tables = []
    for ids, sizes in ((a_all, both.a_size), (b_all, both.b_size)):
        ids = np.array(ids, dtype=np.int64)
        end = np.cumsum(sizes[ids])
        if not np.isin(ends, end).all():
            raise ValueError("a token reaches across a safe space")
        tables.append({"u": np.array(order, dtype=np.int64)[np.searchsorted(ends, end)], "id": ids, "e": end, "k": np.arange(len(ids))})
    return *tables, good


#: Of each end of a token: the tokens of A and B that cover the bytes up to it, whether they end there, and the number of groups before it. Ends of A find B's token and ends of B alone A's.
CUTS = """
CREATE TEMP TABLE cuts AS
WITH covered AS (
    SELECT a.u, a.id AS a, b.id AS b, a.e, true AS a_ends, a.e = b.e AS b_ends FROM ta a ASOF JOIN tb b ON a.e <= b.e
    UNION ALL
    SELECT a.u, a.id, b.id, b.e, false, true FROM (SELECT * FROM tb ANTI JOIN ta USING (e)) b ASOF JOIN ta a ON b.e <= a.e)
SELECT *, coalesce(sum((a_ends AND b_ends)::INTEGER) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS g FROM covered
"""
LINKS = f"CREATE TEMP TABLE links AS SELECT u, (a << {B_BITS}) | b AS pair, count(*) AS n FROM cuts GROUP BY ALL"
PAIRS = "CREATE TEMP TABLE pairs AS SELECT pair, (row_number() OVER (ORDER BY pair) - 1)::INTEGER AS idx FROM (SELECT DISTINCT pair FROM links)"
BY_DOCUMENT = """
CREATE TEMP TABLE linked AS
WITH own AS (SELECT doc, u, count(*) AS times FROM held GROUP BY ALL), indexed AS (SELECT u, idx, n FROM links JOIN pairs USING (pair))
SELECT doc, idx, sum(times * n)::INTEGER AS times FROM own JOIN indexed USING (u) GROUP BY ALL
"""
MADE = ("cuts", "links", "pairs", "linked")

FIELDS = "slice long, is_doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]


def lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def aligned(con: duckdb.DuckDBPyConnection, both: Tokenizers, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Of one slice: sums and digests by document, their pairs (as places in the slice's own list) with the number of links, that list, and in how many documents each of it is linked."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    own = [np.fromiter(map(number.__getitem__, both.units(t)), dtype=np.int32) if t else np.zeros(0, np.int32) for t in texts]
    names = list(number)
    ta, tb, good = intervals(both, names)
    for key, table in (("ta", ta), ("tb", tb)):
        con.register(key, pa.table(table))
    for statement in (CUTS, LINKS, PAIRS):
        con.execute(statement)
    cuts = con.execute("SELECT u, a, b, g, a_ends, b_ends FROM cuts ORDER BY e").fetchnumpy()
    a_ends, b_ends = cuts["a_ends"], cuts["b_ends"]
    counts = [np.bincount(cuts["u"][which], minlength=len(names)) for which in (a_ends, b_ends, a_ends & b_ends, slice(None))]
    spelled = both.spelled(cuts, len(names))
    own = [units if good[units].all() else units[:0] for units in own]
    sizes = np.array([len(x) for x in own], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *own])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    sums = {key: np.bincount(doc, weights=row[flat], minlength=len(texts)).astype(np.int64) for key, row in zip(("n_a", "n_b", "n_groups", "n_links"), counts, strict=True)}
    digests = [hashlib.sha256(";".join(map(spelled.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in own]
    con.register("held", pa.table({"doc": doc, "u": flat}))
    con.execute(BY_DOCUMENT)
    linked = con.execute("SELECT doc, idx, times FROM linked ORDER BY doc, idx").fetchnumpy()
    by_doc = np.bincount(linked["doc"], minlength=len(texts))
    pairs = con.execute("SELECT pair FROM pairs ORDER BY idx").fetchnumpy()["pair"]
    held_by = np.bincount(linked["idx"], minlength=len(pairs))
    out = sums, digests, lists(by_doc, linked["idx"]), lists(by_doc, linked["times"]), pairs, held_by
    for name in MADE:
        con.execute(f"DROP TABLE {name}")
    for name in ("ta", "tb", "held"):
        con.unregister(name)
    return out


def slices(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row for each document (is_doc) and one for each slice, whose pairs are codes and whose times are numbers of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(paths)
        con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        for batch, texts in text_chunks(batches, limit=SLICE_CHARS, most=1 << 30):
            sums, digests, pairs, times, codes, held_by = aligned(con, both, texts)
            name, n = uuid.uuid4().int >> 65, len(texts)
            fixed = [pa.array(np.full(n, name, dtype=np.int64)), pa.array(np.ones(n, dtype=bool)), column(batch, "doc_id").cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([*fixed, *[pa.array(sums[k]) for k in ("n_a", "n_b", "n_groups", "n_links")], pa.array(digests, pa.string()), pairs, times], names=NAMES)
            one = [pa.array([name], pa.int64()), pa.array([False]), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), lists(np.array([len(codes)]), codes), lists(np.array([len(codes)]), held_by)]
            yield pa.RecordBatch.from_arrays(one, names=NAMES)
        con.close()

    return docs.select("doc_id", "text").mapInArrow(run, FIELDS)


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of its A id has more), from rows of pairs with numbers of documents."""
    counts = parts.groupBy("pair").agg(F.sum("docs").alias("n"))
    a = F.shiftright("pair", B_BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A at most, so its size is bounded by the vocabulary
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def with_counts(documents: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of a slice with sums over their links, from the counts of the slice's pairs."""
    size = len(known)
    n, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    idx = known["idx"].to_numpy()
    n[idx], best[idx] = known["n"].to_numpy(), known["best"].to_numpy().astype(np.int64)
    pairs, times = (documents[k].combine_chunks() for k in ("pairs", "times"))
    pairs, times = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (pairs, times))
    doc = np.repeat(np.arange(len(documents)), pairs.value_lengths().to_numpy())
    flat, each = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = []
    for values in (best, n):
        total = np.zeros(len(documents), dtype=np.int64)
        np.add.at(total, doc, each * values[flat])
        sums.append(total)
    cols = [documents[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*cols, *map(pa.array, sums), documents["groups_sha256"]], names=[f.split(" ")[0] for f in OUT.split(", ")])


def alignment(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """The documents' rows of the alignment, and the counts of id pairs (a, b, n, best)."""
    stored = materialize(slices(docs, (a_path, b_path)), "aligned")
    parts = stored.where("NOT is_doc").select("slice", F.posexplode(F.arrays_zip("pairs", "times")).alias("idx", "p")).select("slice", "idx", F.col("p.pairs").alias("pair"), F.col("p.times").alias("docs"))
    counts = materialize(pair_counts(parts), "pair-counts")
    asked = parts.drop("docs").join(counts, "pair").select(F.col("slice").alias("of"), "idx", "n", "best")
    documents = stored.where("is_doc").drop("is_doc")
    rows = documents.groupBy("slice").cogroup(asked.groupBy("of")).applyInArrow(with_counts, OUT)
    return rows, counts.select(F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n", "best")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer_paths())[0]
