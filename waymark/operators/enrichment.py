"""Joining configuration and evidence to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ordered_union
from .quality import reasons

#: Fixed value: the status of records without an entry of their own.
UNVERIFIED = "unverified"


def with_provenance(rows: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Records with source_url, last_verified_at and verification_status of their entry (unique keys); without an entry they are unverified."""
    names = ["source_url", "last_verified_at", "verification_status"]
    e = entries.select(F.col(key).alias("entry_key"), *[F.col(n).alias(f"entry_{n}") for n in names])
    joined = rows.join(e, F.col(key) == F.col("entry_key"), "left")
    status = F.coalesce("entry_verification_status", F.lit(UNVERIFIED))
    kept = [F.col(c) for c in rows.columns if c not in names]
    return joined.select(*kept, F.col("entry_source_url").alias("source_url"), F.col("entry_last_verified_at").alias("last_verified_at"), status.alias("verification_status"))


def unmatched(rows: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Records without an entry."""
    return rows.join(entries.select(F.col(key)).distinct(), key, "left_anti")


def materialised(rows: DataFrame, verified: Column, fields: list[str]) -> DataFrame:
    """Keep the fields of verified records and empty those of others."""
    fine = F.coalesce(verified, F.lit(False))
    return rows.select(*[F.when(fine, F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def promoted(evidence: DataFrame, key: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """For each key whether all of its directions pass all rules, with the reasons of those that do not; keys without a direction that counts pass."""
    judged = evidence.withColumn("why", reasons(rules))
    return judged.groupBy(key).agg(F.coalesce(F.bool_and(F.col("why") == ""), F.lit(True)).alias("is_promoted"), F.array_sort(F.collect_set(F.when(F.col("why") != "", F.col("why")))).alias("reasons"))


#: Lifecycle states without service.
OUT_OF_SERVICE = ("suspended", "merged", "retired")


def reconciled(routes: DataFrame, entries: DataFrame, key: str, verified_on: str) -> DataFrame:
    """Routes with the fields of their configuration entry where it gives them, former codes and aliases joined in order, and planning withdrawn where it must be.

    Both have source_url, effective_from, effective_to, last_verified_at, superseded_by, merged_into, former_codes; routes have aliases and planning_ready too,
    entries verification_status. A route whose status is not verified, or that is out of service, is not ready for planning.
    """
    fields = ["source_url", "effective_from", "effective_to", "last_verified_at", "superseded_by", "merged_into"]
    e = entries.select(F.col(key).alias("entry_key"), *[F.col(c).alias(f"entry_{c}") for c in (*fields, "former_codes", "verification_status")])
    rows = routes.join(e, F.col(key) == F.col("entry_key"), "left")
    new = {c: F.coalesce(f"entry_{c}", c) for c in fields}
    new["last_verified_at"] = F.coalesce("entry_last_verified_at", "last_verified_at", F.lit(verified_on))
    new["verification_status"] = F.coalesce("entry_verification_status", F.lit(UNVERIFIED))
    new["former_codes"] = ordered_union(F.col("former_codes"), F.col("entry_former_codes"))
    new["aliases"] = ordered_union(F.col("aliases"), new["former_codes"])
    fine = (new["verification_status"] == "verified") & ~F.coalesce(F.col("status").isin(*OUT_OF_SERVICE), F.lit(False))
    new["planning_ready"] = F.coalesce(F.col("planning_ready"), F.lit(False)) & fine
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in dict.fromkeys([*routes.columns, "verification_status"])])


def chosen_shapes(existing: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """For each direction the stored shape if it was verified and still passes, else the fetched one if it passes, else none.

    Both have the keys, points and reason (null if it passes, see ``quality.geometry_reason``); ``existing`` has was_verified. Result: points or null, source, verified and the reason.
    """
    old = existing.select(*keys, F.col("points").alias("old"), (F.coalesce("was_verified", F.lit(False)) & F.col("reason").isNull() & F.col("points").isNotNull()).alias("keep"), F.col("reason").alias("old_reason"))
    new = fetched.select(*keys, F.col("points").alias("new"), (F.col("reason").isNull() & F.col("points").isNotNull()).alias("fine"), F.col("reason").alias("new_reason"))
    both = old.join(new, keys, "full_outer")
    keep, fine = F.coalesce("keep", F.lit(False)), F.coalesce("fine", F.lit(False))
    source = F.when(keep, F.lit("stored")).when(fine, F.lit("fetched")).otherwise(F.lit("unresolved"))
    points = F.when(keep, F.col("old")).when(fine, F.col("new"))
    return both.select(*keys, points.alias("points"), source.alias("source"), (keep | fine).alias("verified"), F.when(~(keep | fine), F.coalesce("new_reason", "old_reason", F.lit("no shape"))).alias("reason"))


def with_promoted(stops: DataFrame, shapes: DataFrame, promoted_keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(stops, shapes) after promotion: those of promoted keys count as verified, the shapes of all others are emptied. Both have ``key``; stops status, lat and lng; shapes points and verified."""
    p = promoted_keys.where("is_promoted").select(F.col(key).alias("p_key"))
    s = stops.join(p, F.col(key) == F.col("p_key"), "left")
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    s = s.select(*[F.when(F.col("p_key").isNotNull() & placed, F.lit("verified")).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in stops.columns])
    g = shapes.join(p, F.col(key) == F.col("p_key"), "left")
    known = {"points": F.when(F.col("p_key").isNotNull(), F.col("points")), "verified": F.col("p_key").isNotNull() & F.coalesce("verified", F.lit(False))}
    return s, g.select(*[known.get(c, F.col(c)).alias(c) for c in shapes.columns])
