"""Identifiers: lookups by precedence that report ambiguity, successor chains, and audits of references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

MAX_HOPS = 10


def resolve(tokens: DataFrame, tiers: list[tuple[str, DataFrame]], token: str = "token") -> DataFrame:
    """Resolve each token in the first tier that knows it.

    A tier is (name, table of code and id). Result: token, via, n_candidates, id (null unless there is exactly one), status: resolved, ambiguous or not_found.
    """
    rows = tokens
    for number, (_, codes) in enumerate(tiers):
        grouped = codes.where(F.col("code").isNotNull()).groupBy(F.col("code").alias(f"code{number}")).agg(F.count_distinct("id").alias(f"n{number}"), F.min("id").alias(f"id{number}"))
        rows = rows.join(grouped, F.col(token) == F.col(f"code{number}"), "left")
    pick = lambda what: F.coalesce(*[F.when(F.col(f"n{k}") > 0, F.lit(name) if what == "via" else F.col(f"{what}{k}")) for k, (name, _) in enumerate(tiers)])
    rows = rows.select(token, pick("via").alias("via"), F.coalesce(pick("n"), F.lit(0)).alias("n_candidates"), pick("id").alias("id"))
    status = F.when(F.col("n_candidates") == 0, F.lit("not_found")).when(F.col("n_candidates") > 1, F.lit("ambiguous")).otherwise(F.lit("resolved"))
    return rows.withColumn("status", status).withColumn("id", F.when(F.col("n_candidates") == 1, F.col("id")))


#: Hops that are joined before the starts still on their way are stored.
STEP = 4


def successors(starts: DataFrame, links: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """Follow links (id, next) from each start (id): last, hops and status.

    Status: resolved (no further link), broken_successor_reference (a link to an unknown id), cycle_detected or max_hops_exceeded. Each hop is one join; rows carry their state, so nothing is
    computed twice. After every STEP hops the rows are stored, and only those still on their way go on.
    """
    known = links.select(F.col("id").alias("k_id"), F.col("next").alias("k_next"))
    way = starts.select(F.col("id").alias("start"), F.col("id").alias("last"), F.array("id").alias("path"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("status"))
    done: list[DataFrame] = []
    for hop in range(most + 1):
        on_way = F.col("status").isNull()
        found = F.when(F.col("k_id").isNull(), F.lit("broken_successor_reference")).when(F.col("k_next").isNull(), F.lit("resolved")).when(F.array_contains("path", F.col("k_next")), F.lit("cycle_detected"))
        if hop == most:
            found = F.coalesce(found, F.lit("max_hops_exceeded"))
        goes_on = on_way & found.isNull()
        way = way.join(known, (F.col("last") == F.col("k_id")) & on_way, "left").select(
            "start", F.when(goes_on, F.col("k_next")).otherwise(F.col("last")).alias("last"), F.when(goes_on, F.concat("path", F.array("k_next"))).otherwise(F.col("path")).alias("path"),
            F.when(goes_on, F.lit(hop + 1)).otherwise(F.col("hops")).alias("hops"), F.when(on_way, found).otherwise(F.col("status")).alias("status"),
        )
        if hop == most or hop % STEP == STEP - 1:
            rows = stored(way, "hops")
            done.append(rows.where(F.col("status").isNotNull()).select("start", "last", "hops", "status"))
            way = rows.where(F.col("status").isNull())
            if hop < most and way.isEmpty():
                break
    return reduce(DataFrame.unionByName, done)


def collisions(codes: DataFrame) -> DataFrame:
    """Codes (code, id) that more than one id owns: n_owners, first_owner and last_owner. Owners are counted as distinct rows, so a common code gathers no list."""
    once = codes.where(F.col("code").isNotNull()).select("code", "id").distinct()
    return once.groupBy("code").agg(F.count("*").alias("n_owners"), F.min("id").alias("first_owner"), F.max("id").alias("last_owner")).where(F.col("n_owners") > 1)


def owners(codes: DataFrame) -> DataFrame:
    """The rows (code, id) of codes that more than one id owns."""
    once = codes.where(F.col("code").isNotNull()).select("code", "id").distinct()
    return once.join(collisions(codes).select("code"), "code", "left_semi")


#: The issues that ``audit`` reports.
ISSUES = ("missing_id", "duplicate_id", "broken_reference", "reference_cycle")


def audit(records: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """issue, kind (of link, or null) and id of every fault: rows without an id, ids that occur twice, links to unknown ids, and ids that a chain of one kind of link leads back to.

    ``records`` has id; each table of links has id and next. Each kind of link is followed by itself, so a merger after a replacement is no cycle.
    """
    fault = lambda rows, issue, kind=None: rows.select(F.lit(issue).alias("issue"), F.lit(kind).cast("string").alias("kind"), F.col("id").cast("string").alias("id"))
    known = records.where(F.col("id").isNotNull())
    found = [fault(records.where(F.col("id").isNull()), ISSUES[0]), fault(known.groupBy("id").count().where("count > 1"), ISSUES[1])]
    ids = known.select(F.col("id").alias("known")).distinct()
    for kind, table in links.items():
        given = table.where(F.col("next").isNotNull())
        found.append(fault(given.join(ids, F.col("next") == F.col("known"), "left_anti"), ISSUES[2], kind))
        whole = known.select("id").distinct().join(given.select("id", "next").distinct(), "id", "left")
        found.append(fault(successors(whole.select("id").distinct(), whole).where("status = 'cycle_detected'").select(F.col("start").alias("id")), ISSUES[3], kind))
    return reduce(DataFrame.unionByName, found)


def broken_references(links: DataFrame) -> DataFrame:
    """Links (id, next) to an id that does not exist."""
    return links.where(F.col("next").isNotNull()).join(links.select(F.col("id").alias("known")), F.col("next") == F.col("known"), "left_anti")
