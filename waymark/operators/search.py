"""Catalog and place search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, unaccented
from .parts import PartIndex


def checked_query(origin: Column, destination: Column, placeholders: tuple[str, ...] = ()) -> Column:
    """EMPTY_ORIGIN, EMPTY_DESTINATION, SAME_ORIGIN_DESTINATION, or null for a usable pair; placeholders count as empty."""
    empty = lambda x: (fold(x) == "") | fold(x).isin(*[p for p in placeholders]) if placeholders else fold(x) == ""
    return F.when(empty(origin), F.lit("EMPTY_ORIGIN")).when(empty(destination), F.lit("EMPTY_DESTINATION")).when(fold(origin) == fold(destination), F.lit("SAME_ORIGIN_DESTINATION"))


def contains_folded(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of which a column holds the query, without regard to case and accents. An empty query keeps all rows."""
    wanted = fold(F.lit(query))
    test = F.lit(False)
    for c in columns:
        test = test | fold(F.col(c)).contains(wanted)
    return rows.where((wanted == "") | test)


def category_filter(rows: DataFrame, categories: dict[str, Column], category: str) -> DataFrame:
    """Rows of a category, which is a predicate; an unknown category keeps all rows."""
    return rows.where(categories[category]) if category in categories else rows


def text_score(query: Column, name: Column, other: Column) -> Column:
    """100 if the name starts with the query, 80 if it holds it, 50 if another field does; null for no match. All texts are folded."""
    return F.when(F.length(query) < 2, F.lit(None).cast("int")).when(name.startswith(query), F.lit(100)).when(name.contains(query), F.lit(80)).when(other.contains(query), F.lit(50))


def one_per_point(hits: DataFrame, keys: list[str], lat: str, lng: str, score: str, ordinal: str, limit: int) -> DataFrame:
    """The best hit of each point (coordinates to four decimals), then the best ``limit`` of each key with their rank; ties go to the lower ordinal."""
    at = [F.format_string("%.4f", F.col(lat)), F.format_string("%.4f", F.col(lng))]
    first = Window.partitionBy(*keys, *at).orderBy(F.desc(score), ordinal)
    best = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") == 1)
    top = Window.partitionBy(*keys).orderBy(F.desc(score), ordinal)
    return best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= limit)


def first_filled(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """For each key the rows of the first source that has any (a fallback chain)."""
    ranked = sources[0].withColumn("source_rank", F.lit(0))
    for number, source in enumerate(sources[1:], 1):
        ranked = ranked.unionByName(source.withColumn("source_rank", F.lit(number)))
    best = F.min("source_rank").over(Window.partitionBy(*keys))
    return ranked.withColumn("best_rank", best).where(F.col("source_rank") == F.col("best_rank")).drop("source_rank", "best_rank")


#: What a folded query that holds the first text (or equals one of the second) stands for as well. The first entry that fits counts.
SYNONYMS = [
    (("pho co hoi an",), ("hoi an",), ("pho co hoi an", "hoi an")),
    (("ben xe tt", "ben xe trung tam"), (), ("ben xe tt", "ben xe trung tam")),
    (("cau rong",), (), ("cau rong",)),
    (("cua dai",), (), ("cua dai",)),
    (("san bay",), (), ("san bay",)),
    (("ba na",), (), ("ba na",)),
    (("ngu hanh son",), (), ("ngu hanh son",)),
    (("phu san nhi",), (), ("phu san nhi",)),
]
#: Texts that one expression is made of at most; longer lists of queries are matched in blocks of so many.
MAX_QUERIES = 2_000


def query_tokens(query: Column) -> Column:
    """The folded query and its synonyms, distinct, of two characters at least."""
    q = fold(query)
    more = F.array().cast("array<string>")
    for parts, equals, tokens in reversed(SYNONYMS):
        fits = F.lit(False)
        for x in parts:
            fits = fits | q.contains(F.lit(x))
        for x in equals:
            fits = fits | (q == x)
        more = F.when(fits, F.array(*map(F.lit, tokens))).otherwise(more)
    return F.filter(F.array_distinct(F.concat(F.array(q), more)), lambda t: F.length(t) >= 2)


def stop_matches(tokens: Column, name: Column, street: Column, display: Column, is_first: Column, is_last: Column, start: Column, end: Column) -> Column:
    """Whether a stop fits a query's tokens: a token in its texts, its name of three characters or more in a token, or at an end of the line a token in that terminal's label.

    ``start`` and ``end`` are the labels of the terminals in the direction of travel (origin and destination outbound, the other way round inbound).
    """
    n = fold(name)
    whole = F.concat_ws(" ", n, fold(street), fold(display))
    by_name = F.exists(tokens, lambda t: whole.contains(t) | ((F.length(n) >= 3) & t.contains(n)))
    at = lambda flag, label: F.coalesce(flag, F.lit(False)) & F.exists(tokens, lambda t: fold(label).contains(t))
    return by_name | at(is_first, start) | at(is_last, end)


def matched_stops(tokens: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``tokens`` (token and any ids) with the ``keys`` of each stop that fits, as ``stop_matches`` says; a pair comes once.

    ``stops`` has the keys, name, street, display, is_first, is_last, start and end. Texts are matched through an index of their parts, so there are equi-joins only.
    """
    ids = tokens.columns
    n = fold(F.col("name"))
    fields = [("whole", F.concat_ws(" ", n, fold(F.col("street")), fold(F.col("display"))), F.lit(True)), ("name", n, F.length(n) >= 3)]
    fields += [("label", fold(F.col(label)), F.coalesce(F.col(flag), F.lit(False))) for flag, label in (("is_first", "start"), ("is_last", "end"))]
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.when(test, text).alias("text")) for k, text, test in fields]), lambda f: f["text"].isNotNull())
    rows = stops.select(*keys, F.explode(kinds).alias("f")).select(*keys, "f.kind", "f.text")
    asked = tokens.where(F.length("token") >= 2)
    index = PartIndex.build(rows, "text")
    whole = index.holding(asked, "token").join(rows.where("kind <> 'name'"), "text")
    within = index.held(asked, "token").join(rows.where("kind = 'name'"), "text")
    found = whole.select("token", *keys).unionByName(within.select("token", *keys)).distinct()
    return asked.join(found, "token").select(*ids, *keys)


def token_hits(rows: DataFrame, asked: list[tuple[int, str]], matches) -> DataFrame:
    """The rows with query_id for each of the few ``asked`` (id, token) that ``matches(token)`` holds for; one scan for each block of MAX_QUERIES."""
    out = None
    for k in range(0, max(len(asked), 1), MAX_QUERIES):
        block = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(t).alias("token")) for i, t in asked[k : k + MAX_QUERIES] if len(t) >= 2])
        if not [t for _, t in asked[k : k + MAX_QUERIES] if len(t) >= 2]:
            found = rows.withColumn("query_id", F.lit(0)).where(F.lit(False))
        else:
            found = rows.withColumn("hit", F.explode(F.filter(block, lambda x: matches(x["token"])))).withColumn("query_id", F.col("hit.query_id")).drop("hit")
        out = found if out is None else out.unionByName(found)
    return out


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether a text, folded once, holds one of the folded words."""
    return unaccented(text).rlike("|".join(r"\Q" + w.replace(r"\E", "") + r"\E" for w in words))


def first_matches(rows: DataFrame, query: str, ordinal: str, columns: list[str], when_empty: int = 30, limit: int = 50) -> DataFrame:
    """The first rows in source order of which a column holds the folded query, ``limit`` at most; the first ``when_empty`` for an empty query."""
    found = contains_folded(rows, columns, query)
    return found.orderBy(ordinal).limit(limit if query.strip() else when_empty)


#: Fixed value: degrees within which two places are the same stop.
SAME_DEGREES = 0.0001


def same_stops(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of verified stops (stop_id, name, lat, lng, status) and places (place_id, name, lat, lng) that have one name, or coordinates less than SAME_DEGREES apart.

    Two equi-joins: on names, and on cells of twice that width, of which a place stands in its own and the neighbours. Where ids come once, no pair is found twice: pairs of one name are left to the first join, so
    the pairs, which may be many more than the rows, are neither gathered nor shuffled.
    """
    s = stops.where(F.col("status") == "verified").select("stop_id", F.col("name").alias("s_name"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    p = places.select("place_id", F.col("name").alias("p_name"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    by_name = s.join(p, (F.col("s_name") == F.col("p_name")) & (F.col("s_name") != "")).select("stop_id", "place_id")
    cell = lambda c: F.floor(F.col(c) / (2 * SAME_DEGREES))
    steps = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    cells = p.where(F.col("p_lat").isNotNull() & F.col("p_lng").isNotNull()).withColumn("step", F.explode(steps)).withColumn("y", cell("p_lat") + F.col("step.y")).withColumn("x", cell("p_lng") + F.col("step.x"))
    near = (F.abs(F.col("s_lat") - F.col("p_lat")) < SAME_DEGREES) & (F.abs(F.col("s_lng") - F.col("p_lng")) < SAME_DEGREES)
    by_place = s.withColumn("y", cell("s_lat")).withColumn("x", cell("s_lng")).join(cells.hint("merge"), ["y", "x"])
    named = F.coalesce((F.col("s_name") == F.col("p_name")) & (F.col("s_name") != ""), F.lit(False))
    found = by_name.unionByName(by_place.where(near & ~named).select("stop_id", "place_id"))
    again = lambda rows, key: rows.groupBy(key).count().where("count > 1")
    return found if again(s, "stop_id").isEmpty() and again(p, "place_id").isEmpty() else found.distinct()
