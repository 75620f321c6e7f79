"""Aggregations that build a catalog: counts, indexes and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(t).alias(n) for n, t in tests.items()])


#: Postings of a token are stored in shards of keys.
SHARDS = 256


def postings(rows: DataFrame, key: str, tokens: Column, shards: int = SHARDS) -> DataFrame:
    """Pairs of key and token with the key's shard; a row's own repeats are gone.

    Rows are dealt to tasks by shard before they are cut into tokens, so they are shuffled in place of their many pairs, and a shard's pairs are in one task.
    """
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    return rows.repartition(shard).select(F.col(key).alias("key"), shard.alias("shard"), F.explode(F.array_distinct(tokens)).alias("token"))


def token_counts(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """token, n (distinct keys), first_key and last_key, without lists: partial counts come before the shuffle."""
    return postings(rows, key, tokens).distinct().groupBy("token").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def inverted_index(rows: DataFrame, key: str, tokens: Column, shards: int = SHARDS) -> DataFrame:
    """token, shard, n and the sorted distinct keys of that shard. A frequent token has up to ``shards`` rows, so no row holds all its keys. A null key counts in n as one more, but is not among the keys."""
    found = postings(rows, key, tokens, shards).groupBy("token", "shard").agg(F.collect_set("key").alias("keys"), F.max(F.col("key").isNull().cast("long")).alias("n"))
    return found.select("token", "shard", (F.size("keys") + F.col("n")).alias("n"), F.array_sort("keys").alias("keys"))


#: Ranges of places that names are numbered in, and how exact their bounds are.
RANGES, ACCURACY = 256, 10_000


def directory(rows: DataFrame, name: Column, ordinal: str) -> DataFrame:
    """A dense id for each distinct name, in order of first appearance: name, first_at, n, id.

    Names are numbered within ranges of first places, cut at quantiles (RANGES numbers, all that goes to the driver), and the counts of the ranges before are added.
    ``ordinal`` is numeric; names that first appear at one place are one range.
    """
    names = rows.groupBy(name.alias("name")).agg(F.min(ordinal).alias("first_at"), F.count("*").alias("n"))
    cuts = names.agg(F.percentile_approx("first_at", [k / RANGES for k in range(1, RANGES)], ACCURACY).alias("c")).first()["c"] or []
    bounds = sorted(set(cuts))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("first_at"))) if bounds else F.lit(0)
    names = names.withColumn("range", place)
    before = names.groupBy("range").agg(F.count("*").alias("in_range")).withColumn("before", F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = names.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("first_at", "name")))
    # at most RANGES rows
    return numbered.join(F.broadcast(before.select("range", "before")), "range").select("name", "first_at", "n", (F.col("place") + F.col("before")).alias("id"))


def compact(rows: DataFrame, key: str, lists: list[str], geometry: Column | None = None) -> DataFrame:
    """One row for each key: the length of each list column, the number and the sorted distinct values of all, and whether there is a geometry."""
    empty = F.array().cast("array<string>")
    whole = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(c), empty) for c in lists])))
    sizes = [F.size(F.coalesce(F.col(c), empty)).alias(f"n_{c}") for c in lists]
    shown = [] if geometry is None else [F.coalesce(geometry, F.lit(False)).alias("has_geometry")]
    return rows.select(key, *sizes, whole.alias("names"), *shown).withColumn("n_names", F.size("names"))


def ordered_union(*lists: Column) -> Column:
    """The distinct values of several lists in order of first appearance; null lists are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
