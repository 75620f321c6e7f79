"""Entity resolution: names of places against names of mapped nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_name

#: Fixed values of the score: equal names, prefix, part; least lengths for the latter two.
EXACT, PREFIX, PART = 1.0, 0.95, 0.9
PREFIX_LENGTH, PART_LENGTH = 6, 8


def name_score(target: Column, node: Column) -> Column:
    """EXACT, PREFIX (both longer than 6), PART (both longer than 8, leading numbers agree) or null; texts are normalised before."""
    long = lambda n: (F.length(target) > n) & (F.length(node) > n)
    number = lambda x: F.regexp_extract(x, r"^(\d+)", 1)
    agree = (number(target) == "") | (number(node) == "") | (number(target) == number(node))
    starts = target.startswith(node) | node.startswith(target)
    holds = target.contains(node) | node.contains(target)
    return F.when(target == node, F.lit(EXACT)).when(long(PREFIX_LENGTH) & starts, F.lit(PREFIX)).when(long(PART_LENGTH) & holds & agree, F.lit(PART))


def blocks(name: Column, gram: int = 4) -> Column:
    """Distinct character 4-grams, or the whole name if it is shorter: a name inside another shares all of its own."""
    n = F.length(name) - gram + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(name, i, F.lit(gram))))).otherwise(F.array(name))


def candidates(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """place, node and score of each pair of distinct names that fit: (place_id, place) and (node_id, node) give the names.

    The rarest 4-gram of the shorter name is what pairs meet on: each node stands under all its grams and each place under its rarest one, and the other
    way round. Equal names count once, so a name that many rows have makes no pairs of rows.
    """
    p, n = places.where(F.length("place") > 0).select("place").distinct(), nodes.where(F.length("node") > 0).select("node").distinct()
    scored = meeting(p, n, "place", "node").withColumn("score", name_score(F.col("place"), F.col("node")))
    return scored.where(F.col("score").isNotNull()).distinct()


def meeting(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (a, b) of distinct names of which one may hold the other."""
    p, n = left.select(a, F.explode(blocks(F.col(a))).alias("gram")), right.select(b, F.explode(blocks(F.col(b))).alias("gram"))
    counts = p.select("gram").unionByName(n.select("gram")).groupBy("gram").agg(F.count("*").alias("uses"))
    rarest = lambda df, c: df.join(counts, "gram").groupBy(c).agg(F.min_by("gram", F.struct("uses", "gram")).alias("gram"))
    return rarest(p, a).join(n, "gram").select(a, b).unionByName(p.join(rarest(n, b), "gram").select(a, b)).distinct()


def decided(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each place with candidates: the best score, how many nodes have it, the least of them, and the status: verified if it is one alone, else needs_review.

    Names are decided, and every place takes its name's decision.
    """
    counted = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"))
    scored = candidates(places, nodes).join(counted, "node")
    best = scored.withColumn("top", F.max("score").over(Window.partitionBy("place"))).where(F.col("score") == F.col("top"))
    names = best.groupBy("place").agg(F.max("score").alias("score"), F.sum("n").alias("n_best"), F.min("node_id").alias("node_id"))
    out = places.select("place_id", "place").join(names, "place").drop("place")
    return out.withColumn("status", F.when(F.col("n_best") == 1, F.lit("verified")).otherwise(F.lit("needs_review")))


#: A house number in a stop's name, marks of a stop across the road and what is not one, degrees of a twin corridor.
HOUSE_NUMBER = r"(?:số nhà|đối diện số nhà|đ/d số nhà|đ/d|đối diện)?\s*(\d+[a-z]?(?:\s*[-/]\s*\d+[a-z]?)?)"
ACROSS, NOT_ACROSS = ("đối diện", "đ/d", "d/d"), ("tường rào",)
TWIN_DEGREES = 0.002
#: Names and streets that must not be resolved by their words, with the reason.
NEGATIVES = [
    ("contains 'nam phước' and ('bến xe' or 'tt')", "Nam Phước terminal must not match Da Nang central station or fake IDs"),
    ("street contains 'cửa đại', other name", "Ordinary addresses on Cửa Đại isolated from Cửa Đại beach landmark"),
    ("contains '463 phan bội châu'", "463 Phan Bội Châu isolated from 63 Phan Bội Châu"),
]
BEACH_NAMES = ("cửa đại", "bến tàu cửa đại", "bến thuyền cửa đại")


def negative(name: Column, street: Column) -> Column:
    """The reason why a normalised name must not be resolved, or null."""
    return (
        F.when(name.contains("nam phước") & (name.contains("bến xe") | name.contains("tt")), F.lit(NEGATIVES[0][1]))
        .when(street.contains("cửa đại") & ~name.isin(*BEACH_NAMES), F.lit(NEGATIVES[1][1]))
        .when(name.contains("463 phan bội châu"), F.lit(NEGATIVES[2][1]))
    )


def house(name: Column) -> Column:
    """The house number in a normalised name without blanks, or null."""
    found = F.regexp_extract(name, HOUSE_NUMBER, 1)
    return F.when(found != "", F.replace(found, F.lit(" "), F.lit("")))


def targets(name: Column, street: Column) -> Column:
    """The texts to look for, in order: the house number with its street (across the road or not), the name, and the name with a street it does not hold."""
    number = house(name)
    across = F.exists(F.array(*map(F.lit, ACROSS)), lambda x: name.contains(x)) & ~name.contains(NOT_ACROSS[0])
    text = lambda *parts: plain_name(F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    none = F.array().cast("array<string>")
    numbered = F.when(across, F.array(text("đối diện", number, street), text("đ/d", number, street), text("đối diện", number))).otherwise(F.array(text(number, street), text("số nhà", number, street)))
    first = F.when(number.isNotNull() & (street != ""), numbered).otherwise(none)
    last = F.when((street != "") & ~name.contains(street), F.array(text(name, street))).otherwise(none)
    return F.concat(first, F.array(name), last)


def target_hit(wanted: Column, node: Column) -> Column:
    """struct<score, how> of the first target that a node's name fits: exact, prefix (both longer than 6), substring (both longer than 8, first numbers alike), or null."""

    def leading(x: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(x, r"(?U)\b(\d+[a-z]?)\b", 1), "[a-z]", "").try_cast("long")

    def one(t: Column) -> Column:
        both = lambda n: (F.length(t) > n) & (F.length(node) > n)
        apart = F.coalesce(leading(t) != leading(node), F.lit(False))
        hit = lambda score, how: F.struct(F.lit(score).alias("score"), F.lit(how).alias("how"))
        starts, holds = t.startswith(node) | node.startswith(t), t.contains(node) | node.contains(t)
        return F.when(t == node, hit(EXACT, "exact")).when(both(PREFIX_LENGTH) & starts, hit(PREFIX, "prefix")).when(both(PART_LENGTH) & holds & ~apart, hit(PART, "substring"))

    return F.try_element_at(F.filter(F.transform(wanted, one), lambda h: h.isNotNull()), F.lit(1))


def resolve(places: DataFrame, nodes: DataFrame, landmarks: list[tuple[Column, str]] | None = None, negatives: Column | None = None) -> DataFrame:
    """place_id, status (verified, needs_review or unresolved), node_id, method, confidence, n_candidates and reason of every place.

    ``places``: place_id, name, street; ``nodes``: node_id, name, description, lat, lng, ordinal. ``landmarks`` are audited conditions on ``place`` and ``street`` (normalised) with the node
    each stands for, the first one wins; ``negatives`` gives a reason not to resolve (``negative`` by default).

    Distinct pairs of name and street are decided and then joined to their places. For each, nodes that fit a target are candidates. A
    single one must share a word of the street unless it is exact. Of several the one with the very house number counts, if it is unique; else, if all lie within
    TWIN_DEGREES of the first, the best; else the one whose texts hold all words of the street, if unique. All of this is aggregates over
    candidates, so a name with many of them gathers no list.
    """
    named = places.select("place_id", plain_name(F.col("name")).alias("place"), plain_name(F.col("street")).alias("street"))
    keys = ["place", "street"]
    asked = named.select(*keys).distinct()
    mark = F.lit(None).cast("string")
    for test, node in reversed(landmarks or []):
        mark = F.when(test, F.lit(node)).otherwise(mark)
    asked = asked.withColumn("mark", mark).withColumn("why", negative(F.col("place"), F.col("street")) if negatives is None else negatives).withColumn("targets", targets(F.col("place"), F.col("street")))
    known = nodes.select("node_id", "ordinal", "lat", "lng", plain_name(F.col("name")).alias("node"), plain_name(F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))).alias("words")).where(F.length("node") > 0)
    open_ = asked.where(F.col("mark").isNull() & F.col("why").isNull())
    texts = open_.select(*keys, "targets", F.explode(F.filter("targets", lambda t: F.length(t) > 0)).alias("target"))
    pairs = meeting(texts.select("target").distinct(), known.select("node").distinct(), "target", "node")
    met = texts.join(pairs, "target").select(*keys, "targets", "node").distinct().withColumn("hit", target_hit(F.col("targets"), F.col("node"))).where(F.col("hit").isNotNull())
    every = met.join(known, "node").select(*keys, "node", "node_id", "ordinal", "lat", "lng", "words", "hit.score", "hit.how")
    street_words = F.filter(F.split("street", " "), lambda w: F.length(w) > 2)
    number = F.regexp_extract("node", r"(?U)\b(\d+[a-z]?)\b", 1)
    every = every.withColumn("same_number", F.coalesce(number == house(F.col("place")), F.lit(False)))
    every = every.withColumn("any_word", (F.size(street_words) == 0) | F.exists(street_words, lambda w: F.col("words").contains(w))).withColumn("all_words", (F.size(street_words) > 0) & F.forall(street_words, lambda w: F.col("words").contains(w)))
    # a node that appears twice counts once, with its best score
    once = every.groupBy(*keys, "node_id").agg(F.max_by(F.struct("ordinal", "lat", "lng", "score", "how", "same_number", "any_word", "all_words"), F.struct("score", -F.col("ordinal"))).alias("c")).select(*keys, "node_id", "c.*")
    row = F.struct("node_id", "score", "how", "any_word", "lat", "lng")
    picked = lambda test: F.min_by(F.when(test, row), F.when(test, F.col("ordinal")))
    found = once.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("same_number").alias("n_number"), F.count_if("all_words").alias("n_words"),
        picked(F.col("same_number")).alias("numbered"), picked(F.col("all_words")).alias("worded"), F.min_by(row, "ordinal").alias("first"), F.max_by(row, F.struct("score", -F.col("ordinal"))).alias("best"),
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"),
    )
    close = lambda low, high, c: (F.col(high) - F.col(f"first.{c}") < TWIN_DEGREES) & (F.col(f"first.{c}") - F.col(low) < TWIN_DEGREES)
    twin = close("south", "north", "lat") & close("west", "east", "lng")
    out = lambda c, method, sure: F.struct(F.lit("verified").alias("status"), F.col(f"{c}.node_id").alias("node_id"), method.alias("method"), F.when(sure, F.lit("high")).otherwise(F.lit("medium")).alias("confidence"))
    how = lambda c, stem: F.concat(F.lit(stem), F.col(f"{c}.how"))
    exact = lambda c: F.col(f"{c}.score") == EXACT
    verdict = (
        F.when((F.col("n") == 1) & (exact("first") | F.col("first.any_word")), out("first", how("first", "name_"), exact("first")))
        .when((F.col("n") > 1) & (F.col("n_number") == 1), out("numbered", how("numbered", "number_"), exact("numbered")))
        .when((F.col("n") > 1) & twin, out("best", F.lit("twin_corridor"), F.lit(False)))
        .when((F.col("n") > 1) & (F.col("n_words") == 1), out("worded", F.lit("street"), exact("worded")))
    )
    decisions = found.select(*keys, "n", verdict.alias("v"))
    every_name = asked.join(decisions, keys, "left").select(
        *keys,
        F.when(F.col("mark").isNotNull(), F.lit("verified")).when(F.col("why").isNotNull() | F.col("n").isNull(), F.lit("unresolved")).otherwise(F.coalesce("v.status", F.lit("needs_review"))).alias("status"),
        F.coalesce("mark", F.col("v.node_id").cast("string")).alias("node_id"), F.when(F.col("mark").isNotNull(), F.lit("landmark")).otherwise(F.col("v.method")).alias("method"),
        F.when(F.col("mark").isNotNull(), F.lit("high")).otherwise(F.col("v.confidence")).alias("confidence"), F.coalesce("n", F.lit(0)).alias("n_candidates"), F.col("why").alias("reason"),
    )
    return named.join(every_name, keys).select("place_id", "status", "node_id", "method", "confidence", "n_candidates", "reason")
