"""Order-sensitive operators: ordered pairs, monotone checks, gap clusters and greedy alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import BADGES

#: Fixed values of the alignment: words that carry no meaning, window around the last match, least score.
STOP_WORDS = ("số", "đối", "diện", "đường", "bến", "xe")
BACK, AHEAD, LEAST_SCORE = 2, 8, 50


def first_ordered_pair(rows: DataFrame, keys: list[str], at: str, is_first: Column, is_second: Column) -> DataFrame:
    """For each key the first row that matches ``is_first`` and has a later ``is_second`` row, with the first such one, by place ``at``.

    The first origin with any later destination is the earliest origin, if it lies before the last destination.
    """
    marked = rows.select(*keys, F.col(at).alias("at"), is_first.alias("o"), is_second.alias("d"))
    ends = marked.groupBy(*keys).agg(F.min(F.when(F.col("o"), F.col("at"))).alias("first_at"), F.max(F.when(F.col("d"), F.col("at"))).alias("last_d")).where(F.col("first_at") < F.col("last_d"))
    later = marked.where("d").join(ends.select(*keys, "first_at"), keys).where(F.col("at") > F.col("first_at"))
    return later.groupBy(*keys, "first_at").agg(F.min("at").alias("second_at"))


def monotone(rows: DataFrame, keys: list[str], at: str, value: Column) -> DataFrame:
    """For each key: the number of rows, and whether ``value`` strictly rises along ``at`` (ties: along the value); a missing value counts as 0."""
    v = F.coalesce(value, F.lit(0))
    by = Window.partitionBy(*keys).orderBy(F.col(at), v)
    steps = rows.select(*keys, (v < F.lead(v).over(by)).alias("rises"))
    return steps.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.coalesce(F.bool_and("rises"), F.lit(True)).alias("is_monotone"))


def inversions(rows: DataFrame, keys: list[str], at: str, value: str, slack: float, falling: Column | None = None) -> DataFrame:
    """Rows whose value goes back by more than ``slack`` against the row before (or forward, where ``falling`` holds)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(at))
    back = before - F.col(value) if falling is None else F.when(falling, F.col(value) - before).otherwise(before - F.col(value))
    return rows.withColumn("back", back).where(F.col("back") > slack)


def gap_clusters(rows: DataFrame, keys: list[str], at: Column, gap: float, bucket: Column | None = None, crowd: int | None = None) -> DataFrame:
    """Add ``cluster``: numbered from 0, a new one where ``at`` is more than ``gap`` beyond the row before.

    ``bucket``, a number that never falls as ``at`` rises, cuts busy keys: rows look back within their bucket, and the last row and the number of clusters of the
    buckets before come from a table of buckets. Without it a key is one group; so it is with ``crowd``, if no key has more rows than that.
    """
    if bucket is not None and crowd is not None and rows.groupBy(*keys).count().where(F.col("count") > crowd).isEmpty():
        bucket = None
    if bucket is None:
        order = Window.partitionBy(*keys).orderBy("gap_at")
        rows = rows.withColumn("gap_at", at).withColumn("gap_fresh", F.when(F.col("gap_at") - F.lag("gap_at").over(order) > gap, 1).otherwise(0))
        number = F.sum("gap_fresh").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumn("cluster", number).drop("gap_at", "gap_fresh")
    rows = rows.withColumn("gap_at", at).withColumn("gap_bucket", bucket)
    cut = [*keys, "gap_bucket"]
    own, along = Window.partitionBy(*cut).orderBy("gap_at"), Window.partitionBy(*keys).orderBy("gap_bucket")

    def joined(left: DataFrame, table: DataFrame) -> DataFrame:
        right = table.select(*[F.col(c).alias(f"gap_{k}") for k, c in enumerate(cut)], *[c for c in table.columns if c not in cut])
        same = F.lit(True)
        for k, c in enumerate(cut):
            same = same & F.col(c).eqNullSafe(F.col(f"gap_{k}"))
        return left.join(right, same).drop(*[f"gap_{k}" for k in range(len(cut))])

    lasts = rows.groupBy(*cut).agg(F.max("gap_at").alias("gap_last")).withColumn("gap_before", F.lag("gap_last").over(along)).drop("gap_last")
    rows = joined(rows, lasts)
    fresh = F.when(F.col("gap_at") - F.coalesce(F.lag("gap_at").over(own), "gap_before") > gap, 1).otherwise(0)
    rows = rows.withColumn("gap_fresh", fresh)
    bases = rows.groupBy(*cut).agg(F.sum("gap_fresh").alias("gap_new")).withColumn("gap_base", F.coalesce(F.sum("gap_new").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("gap_new")
    rows = joined(rows, bases)
    number = F.col("gap_base") + F.sum("gap_fresh").over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("cluster", number).drop("gap_at", "gap_bucket", "gap_before", "gap_fresh", "gap_base")


def with_ends(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Add is_first and is_last: whether the row has the least or the greatest place of its keys."""
    ends = rows.groupBy(*keys).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return rows.join(ends, keys).withColumn("is_first", F.col(at) == F.col("first_at")).withColumn("is_last", F.col(at) == F.col("last_at")).drop("first_at", "last_at")


#: Fixed values of labels beside a line: those further left do not count; where the upper side ends; the gap between labels.
LABELS_FROM, UPPER_TO, LABEL_GAP = 400.0, 218.0, 12.0


def ray_labels(items: DataFrame, keys: list[str], split: float = UPPER_TO) -> DataFrame:
    """keys, side (upper or lower), mean_left and label of the labels that pieces of text (left, top, text) make up.

    Pieces belong together while the gaps of ``left + top`` are LABEL_GAP at most; they are joined by ``left``, without the numbers of transfer lines before them. Labels
    of one character, and bare numbers, do not count.
    """
    rows = items.where(F.col("left") >= LABELS_FROM).withColumn("side", F.when(F.col("top") < split, F.lit("upper")).otherwise(F.lit("lower")))
    rows = gap_clusters(rows, [*keys, "side"], F.col("left") + F.col("top"), LABEL_GAP)
    parts = F.array_sort(F.collect_list(F.struct("left", "top", "text")))
    found = rows.groupBy(*keys, "side", "cluster").agg(F.avg("left").alias("mean_left"), parts.alias("parts"))
    label = F.regexp_replace(F.trim(F.array_join(F.col("parts.text"), "")), BADGES, "")
    found = found.withColumn("label", label).where((F.length("label") > 1) & ~F.col("label").rlike(r"^\d{1,2}$"))
    return found.select(*keys, "side", "mean_left", "label")


def meaning(text: Column) -> Column:
    """The distinct words of a normalised text that carry meaning."""
    return F.filter(F.array_distinct(F.split(text, r"\s+")), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def score(name: Column, label: Column) -> Column:
    """Of structs with text and words: 100 for equal texts, 85 if one is in the other and both have at least 6 characters, else 80 times the share of the name's words that the label has."""
    a, b = name["text"], label["text"]
    part = (F.length(a) >= 6) & (F.length(b) >= 6) & (a.contains(b) | b.contains(a))
    share = F.size(F.array_intersect(name["words"], label["words"])) / F.greatest(F.size(name["words"]), F.lit(1))
    return F.when(a == b, F.lit(100)).when(part, F.lit(85)).otherwise(F.floor(share * 80).cast("int"))


#: One row of an alignment; a name known by other evidence has no label and the score 100.
ALIGNED = "struct<name_at:bigint,label_at:bigint,score:int>"


def align(names: Column, labels: Column) -> Column:
    """array of ALIGNED in the order of names, greedily: the best label not yet used, BACK places before the last match to AHEAD after it; the first among equals.

    Both are arrays of structs in their order, with i (from 0), at, text and words; names have terminal, which marks those that take no label. The fold carries the place of the last match, the labels
    used within reach of it, and what was found.
    """
    state = f"struct<reached:int,used:array<int>,found:array<{ALIGNED}>>"
    begin = F.struct(F.lit(0).alias("reached"), F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{ALIGNED}>").alias("found")).cast(state)

    def step(acc: Column, name: Column) -> Column:
        low = F.greatest(F.lit(0), acc["reached"] - BACK)
        near = F.filter(F.slice(labels, low + 1, acc["reached"] + AHEAD - low), lambda x: ~F.array_contains(acc["used"], x["i"]))
        # the greatest score, then the first place
        best = F.array_max(F.transform(near, lambda x: F.struct(score(name, x).alias("score"), (-x["i"]).alias("back"), x["at"].alias("at"))))
        fits = F.coalesce(best["score"] >= LEAST_SCORE, F.lit(False))
        reached = F.greatest(acc["reached"], -best["back"])
        used = F.filter(F.concat(acc["used"], F.array(-best["back"])), lambda u: u >= reached - BACK)
        row = lambda at, points: F.struct(name["at"].alias("name_at"), at.alias("label_at"), points.alias("score")).cast(ALIGNED)
        add = lambda x: F.concat(acc["found"], F.array(x))
        known = F.struct(acc["reached"].alias("reached"), acc["used"].alias("used"), add(row(F.lit(None).cast("long"), F.lit(100))).alias("found")).cast(state)
        hit = F.struct(reached.alias("reached"), used.alias("used"), add(row(best["at"], best["score"])).alias("found")).cast(state)
        return F.when(name["terminal"], known).when(fits, hit).otherwise(acc)

    return F.aggregate(names, begin, step, lambda acc: acc["found"])


def align_groups(names: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name_at, label_at and score of the greedy alignment of each group's names with its labels. A group is one direction of a line, so it is small.

    Both have ``at`` (whole numbers, the order of a side) and ``text``, already normalised; names may have ``terminal``, a flag for those known by other evidence.
    """
    flag = F.coalesce(F.col("terminal"), F.lit(False)) if "terminal" in names.columns else F.lit(False)

    def side(rows: DataFrame, name: str, terminal: Column) -> DataFrame:
        row = F.struct(F.col("at").cast("long").alias("at"), F.coalesce("text", F.lit("")).alias("text"), terminal.alias("terminal"))
        given = F.transform(F.array_sort(F.collect_list(row)), lambda x, i: F.struct(i.alias("i"), x["at"].alias("at"), x["text"].alias("text"), meaning(x["text"]).alias("words"), x["terminal"].alias("terminal")))
        return rows.groupBy(*keys).agg(given.alias(name))

    both = side(names, "a_side", flag).join(side(labels, "b_side", F.lit(False)), keys, "left")
    nothing = F.array().cast(both.schema["b_side"].dataType)
    found = align(F.col("a_side"), F.coalesce("b_side", nothing))
    return both.select(*keys, F.explode(found).alias("f")).select(*keys, "f.name_at", "f.label_at", F.col("f.score").cast("long").alias("score"))


#: Fixed value: how far a label may stand before the one of the stop before it.
POSITION_SLACK = 50.0


def alignment_report(names: DataFrame, labels: DataFrame, found: DataFrame, keys: list[str], falling: Column | None = None) -> DataFrame:
    """For each group: n_labels, n_names, n_aligned, rate in per cent, inversions, is_monotone, and the places of names and labels without a partner.

    ``labels`` has ``position``, the place along the drawing, and ``names`` may have it for terminals; ``falling``, a condition on the keys, tells groups whose positions fall.
    """
    place = labels.select(*keys, F.col("at").alias("label_at"), F.col("position").alias("label_position"))
    known = names.select(*keys, F.col("at").alias("name_at"), (F.col("position") if "position" in names.columns else F.lit(None).cast("double")).alias("name_position"))
    matched = found.join(place, [*keys, "label_at"], "left").join(known, [*keys, "name_at"], "left").withColumn("position", F.coalesce("label_position", "name_position"))
    turned = inversions(matched.where(F.col("position").isNotNull()), keys, "name_at", "position", POSITION_SLACK, falling).groupBy(*keys).agg(F.count("*").alias("inversions"))
    counts = [
        labels.groupBy(*keys).agg(F.count("*").alias("n_labels")),
        found.groupBy(*keys).agg(F.count("*").alias("n_aligned")),
        turned,
        names.join(found.select(*keys, F.col("name_at").alias("at")), [*keys, "at"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list("at")).alias("unmatched_names")),
        labels.join(found.select(*keys, F.col("label_at").alias("at")), [*keys, "at"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list("at")).alias("unmatched_labels")),
    ]
    out = names.groupBy(*keys).agg(F.count("*").alias("n_names"))
    for c in counts:
        out = out.join(c, keys, "left")
    out = out.na.fill(0, ["n_labels", "n_aligned", "inversions"])
    none = F.array().cast("array<long>")
    return out.withColumn("rate", F.round(F.col("n_aligned") * 100.0 / F.col("n_names"), 1)).withColumn("is_monotone", F.col("inversions") == 0).withColumn("unmatched_names", F.coalesce("unmatched_names", none)).withColumn("unmatched_labels", F.coalesce("unmatched_labels", none))
