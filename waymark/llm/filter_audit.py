"""Interaction audit of filters: what each filter removes at each place of every order in which the filters can run.

The orders form a trie of prefixes. It is walked depth first: at each node the survivors of the prefix are a persisted DataFrame, one more
filter is applied to it for each edge, and what this filter actually removes is counted by part. Prefixes that hold the same filters in another order
leave the same survivors, so such a state is computed once and remembered: 2**n states in place of n! leaves, and never more than n persisted tables, as a
state is given up once its subtree is done. Counts are stored as they come; rows of all orders are then joins of the counts with the table of orders,
whose size depends on the number of filters only.

Survivors are narrow rows (part, failed filters, label marks), so no state holds texts. Counting is a partial aggregate by part: a part that holds most rows costs no task more
than its own rows.

Defined cases: a null text counts as empty; a null language is the part '' ; null ids have no labels and are never smaller or larger than another id; rows that share
id and text are separate documents, none of which is the other's copy; a document fails the copy filter if a row with a smaller id has its text (texts are
equal if their SHA-256 digests are); labels of a repeated id count if any of them is 1; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, discard, materialize, shared_dir

FILTERS = "ABCDE"


def failures() -> dict[str, Column]:
    """Failure conditions that a document's own text decides, from the columns text and words."""
    text, words = F.col("text"), F.col("words")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame) -> DataFrame:
    """part, doc_id, digest of the text, and a boolean column for each of the filters A to E."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, WORD_PATTERN.replace("^", "")), lambda w: w != "")
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("part"), "doc_id", text.alias("text"), words.alias("words"))
    own = materialize(rows.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in failures().items()]), "judged")
    # texts that several ids have, each with its least id; a stored table, so that the join back can split a text that very many rows share
    shared = own.groupBy(F.col("digest").alias("shared")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("shared", "least")
    shared = materialize(shared, "shared-texts")
    out = own.join(shared, F.col("digest") == F.col("shared"), "left")
    return out.select("part", "doc_id", *"ABCD", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))


def marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with booleans good and toxic, from labels by id."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good OR toxic")
    # ids meet once in the labels; a stored side lets a repeated id of documents be split
    joined = rows.join(materialize(marks, "marks"), F.col("doc_id") == F.col("labelled"), "left")
    return joined.select(*[c for c in rows.columns if c != "doc_id"], F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


class Trie:
    """Depth-first walk over prefixes of filters; ``path`` receives a table of counts by part for every edge."""

    def __init__(self, filters: Sequence[str], path: str):
        self.filters = filters
        self.path = path
        self.done: set[frozenset[str]] = set()

    def visit(self, survivors: DataFrame, prefix: frozenset[str] = frozenset()) -> None:
        """Count the edges below ``prefix``, whose survivors are given, and then those of its children."""
        self.done.add(prefix)
        following = [f for f in self.filters if f not in prefix]
        if not following:
            return
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.count_edges(held, prefix, following)
            for f in following:
                if (child := prefix | {f}) not in self.done:
                    self.visit(held.where(~F.col(f)), child)
        finally:
            held.unpersist()

    def count_edges(self, held: DataFrame, prefix: frozenset[str], following: list[str]) -> None:
        """What each following filter removes of the survivors: one pass for all edges of the state."""
        edges = [F.struct(F.lit(f).alias("filter"), *[F.col(f"{f}_{k}").alias(k) for k in ("removed", "good_lost", "toxic_lost")]) for f in following]
        sums = [count(c).alias(f"{f}_{k}") for f in following for k, c in (("removed", F.col(f)), ("good_lost", F.col(f) & F.col("good")), ("toxic_lost", F.col(f) & F.col("toxic")))]
        by_part = held.groupBy("part").agg(F.count("*").alias("before"), *sums)
        out = by_part.select("part", F.lit("".join(sorted(prefix))).alias("state"), "before", F.explode(F.array(*edges)).alias("e"))
        out.select("part", "state", "before", "e.*").write.mode("append").parquet(self.path)


def order_table(spark: SparkSession, filters: Sequence[str]) -> DataFrame:
    """filter_order, step, filter and the state before the step, for each order of the filters."""
    rows = [("".join(order), k + 1, f, "".join(sorted(order[:k]))) for order in permutations(filters) for k, f in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, state string")


def interactions(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """The audit of rows with a string ``part``, booleans ``good`` and ``toxic`` and a boolean column for each filter, true where a row fails it.

    A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (the filter's removals summed over all orders).
    Filters have names of one letter; there are n! orders, so they are few.
    """
    spark = rows.sparkSession
    held = materialize(rows.select("part", *filters, "good", "toxic"), "audited")
    path = f"{shared_dir(spark)}/waymark-edges-{uuid.uuid4().hex}"
    Trie(filters, path).visit(held)
    edges = spark.read.schema("part string, state string, before long, filter string, removed long, good_lost long, toxic_lost long").parquet(path)

    others = {f: [F.col(g) for g in filters if g != f] for f in filters}
    alone = {f: F.col(f) & ~F.greatest(*others[f]) if others[f] else F.col(f) for f in filters}
    sums = [s for f in filters for s in (count(F.col(f)).alias(f"{f}_fails"), count(alone[f]).alias(f"{f}_unique"))]
    totals = held.groupBy("part").agg(*sums)
    # every part has every edge; where no row of a part is left, nothing was counted
    every = [F.struct(F.lit("".join(sorted(state))).alias("state"), F.lit(f).alias("filter"), F.col(f"{f}_fails").alias("fails"), F.col(f"{f}_unique").alias("unique_fails")) for f in filters for state in subsets([g for g in filters if g != f])]
    dense = totals.select("part", F.explode(F.array(*every)).alias("e")).select("part", "e.*").join(edges, ["part", "state", "filter"], "left")
    dense = materialize(dense.fillna(0, ["before", "removed", "good_lost", "toxic_lost"]), "edges")
    n = len(filters)
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.length("state") + 1)
    shapley = dense.groupBy(F.col("part").alias("p"), F.col("filter").alias("f")).agg(F.sum(weight * F.col("removed")).alias("shapley"))
    summed = dense.join(shapley, (F.col("part") == F.col("p")) & (F.col("filter") == F.col("f")))
    out = summed.join(F.broadcast(order_table(spark, filters)), ["state", "filter"])
    return out.select("part", "filter_order", "step", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def subsets(of: list[str]) -> list[list[str]]:
    found: list[list[str]] = [[]]
    for f in of:
        found += [[*s, f] for s in found]
    return found


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return interactions(marked(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))


AUDIT_SQL = r"""
WITH words AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT coalesce(text, '') AS same, min(doc_id) AS least FROM documents GROUP BY 1),
marks AS (SELECT doc_id AS labelled, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
    FROM words JOIN firsts ON text = same LEFT JOIN marks ON doc_id = labelled),
kinds AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
ends AS (SELECT filter_order, part, fails, good, toxic, n, coalesce(list_min(list_transform(string_split(fails, ''), lambda x: CASE WHEN x = '' THEN 9 ELSE instr(filter_order, x) END)), 9) AS ended FROM orders, kinds),
counts AS (
    SELECT e.part, s.filter_order, s.step, s.f,
        CAST(sum(CASE WHEN ended > s.step THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN ended = s.step THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN ended < s.step AND contains(fails, s.f) THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN fails = s.f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN ended = s.step THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN ended = s.step THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM steps s JOIN ends e USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counts
"""
