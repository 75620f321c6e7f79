"""URL filters: fixed rules first, then a path-template tree for each host, judged by smoothed labelled purity.

Path segments become shapes (digits become ``#``). Pages are counted by host and shapes at once, so a hot host becomes its few different paths before anything
is joined. The tree grows from the root down, a level at a time, as tables of nodes: below a node with more than MAX_CHILDREN different segments
those that are rare (see ``kept``) become ``*``; then siblings, ordered by share of blocked pages, are merged with the one before them if both have labelled
pages, their labels do not differ (two-proportion z under Z_SAME) and neither does what hangs below them (a two-sample chi-squared of the next
segments, which takes the counts into account). A merged branch is one node for the levels below. A branch without labelled pages never merges, so it is
not rejected for its neighbours. Generalising goes on to LEVELS levels; deeper segments stay as they are. A template is a whole path of the tree; its
purity is its share of blocked labelled pages, smoothed by SMOOTHING pages of the overall share. Templates of REJECT_AT or more are rejected.
Labels are the verdicts of the rules.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; null ids are carried; repeated rows are pages like others; without
any labelled page nothing is rejected; an empty table gives an empty result; other columns do not matter. Rules are configuration: at most
MAX_RULES of them, tested as one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed rules: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MAX_RULES = 500
#: Levels that are generalised; children that a node may have before rare ones become ``*``; pages and share (one in so many) that keep a child apart.
LEVELS, MAX_CHILDREN, MIN_PAGES, MIN_SHARE = 16, 8, 5, 50
Z_SAME = 1.96
SMOOTHING, REJECT_AT = 5.0, 0.7
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame) -> DataFrame:
    """Add host (A-Z in lower case) and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(url, URL, 2))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add rule (host and path of the longest rule that fits, or null) and rule_verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def shaped(pages: DataFrame) -> DataFrame:
    """Add shapes: the path's segments without empty ones, runs of digits as ``#``, joined by slashes."""
    parts = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    return pages.withColumn("shapes", F.array_join(parts, "/"))


def kept() -> Column:
    """Whether a child with its parent's ``kinds`` and ``whole`` stays apart: few siblings, or MIN_PAGES pages and labels or a share of one in MIN_SHARE."""
    return (F.col("kinds") <= MAX_CHILDREN) | ((F.col("n") >= MIN_PAGES) & ((F.col("labelled") > 0) | (F.col("n") * MIN_SHARE >= F.col("whole"))))


def sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]


def generalised(rows: DataFrame) -> DataFrame:
    """node, seg and g: what each segment below a node is called. ``rows`` has node, seg, n, blocked and labelled."""
    kids = rows.groupBy("node", "seg").agg(*sums())
    parents = kids.groupBy(F.col("node").alias("p")).agg(F.count("*").alias("kinds"), F.sum("n").alias("whole"))
    return kids.join(parents, F.col("node") == F.col("p")).withColumn("g", F.when(kept(), F.col("seg")).otherwise(F.lit("*"))).drop("p", "kinds", "whole")


def alike_below(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """node and g of the pairs (node, g, before) whose next segments do not differ: two-sample chi-squared at most its mean and two standard deviations."""
    sides = [pairs.select("node", "g", F.col(x).alias("name"), F.lit(k).alias("side")) for k, x in enumerate(("g", "before"))]
    cells = sides[0].unionByName(sides[1]).join(below.select(F.col("node").alias("b_node"), F.col("g").alias("b_g"), "next", "m"), (F.col("node") == F.col("b_node")) & (F.col("name") == F.col("b_g")))
    both = cells.groupBy("node", "g", "next").agg(*[F.sum(F.when(F.col("side") == k, F.col("m")).otherwise(0)).alias(x) for k, x in enumerate("ab")])
    sums = both.groupBy(F.col("node").alias("s_node"), F.col("g").alias("s_g")).agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    both = both.join(sums, (F.col("node") == F.col("s_node")) & (F.col("g") == F.col("s_g")))
    scaled = F.col("a") * F.sqrt(F.col("all_b") / F.col("all_a")) - F.col("b") * F.sqrt(F.col("all_a") / F.col("all_b"))
    tested = both.groupBy("node", "g").agg(F.sum(scaled * scaled / (F.col("a") + F.col("b"))).alias("x"), (F.count("*") - 1).alias("df"))
    return tested.where(F.col("x") <= F.col("df") + 2 * F.sqrt(2 * F.col("df")) + 1e-9).select("node", "g")


def merged(named: DataFrame, below: DataFrame) -> DataFrame:
    """node, g and branch: the first name of the merged branch that a child g belongs to."""
    kids = named.groupBy("node", "g").agg(*sums())
    by = Window.partitionBy("node").orderBy((F.col("blocked") + 0.5) / (F.col("labelled") + 1.0), "g")
    rows = kids.select("*", *[F.lag(c).over(by).alias(f"p_{c}") for c in ("g", "blocked", "labelled")])
    pooled = (F.col("blocked") + F.col("p_blocked")) / (F.col("labelled") + F.col("p_labelled"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("p_labelled")))
    apart = F.abs(F.col("blocked") / F.col("labelled") - F.col("p_blocked") / F.col("p_labelled"))
    labelled = (F.col("labelled") > 0) & (F.col("p_labelled") > 0)
    close = rows.where(labelled & ((pooled <= 0) | (pooled >= 1) | (apart < Z_SAME * spread))).select("node", "g", F.col("p_g").alias("before"))
    same = alike_below(close, below).select(F.col("node").alias("m_node"), F.col("g").alias("m_g"))
    rows = rows.join(same, (F.col("node") == F.col("m_node")) & (F.col("g") == F.col("m_g")), "left").withColumn("fresh", F.when(F.col("m_node").isNull(), 1).otherwise(0))
    numbered = rows.withColumn("number", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.select("node", "g", F.first("g").over(Window.partitionBy("node", "number").orderBy((F.col("blocked") + 0.5) / (F.col("labelled") + 1.0), "g")).alias("branch"))


def templates(pages: DataFrame, levels: int = LEVELS) -> DataFrame:
    """host, shapes, template, purity and rejected of every path seen, from pages with shapes and rule verdicts."""
    label = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
    counts = pages.groupBy("host", "shapes").agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("blocked"), F.count(label).alias("labelled"))
    parts = F.filter(F.split("shapes", "/"), lambda x: x != "")
    counts = materialize(counts.withColumn("node", F.concat("host", F.lit("/"))).withColumn("depth", F.size(parts)), "paths")
    deepest = counts.agg(F.max("depth")).first()[0] or 0
    for level in range(1, min(deepest, levels) + 1):
        rows = counts.where(F.col("depth") >= level).withColumn("seg", F.element_at(parts, level))
        called = generalised(rows)
        names = called.select(F.col("node").alias("c_node"), F.col("seg").alias("c_seg"), "g")
        following = F.coalesce(F.try_element_at(parts, F.lit(level + 1)), F.lit(""))
        below = rows.groupBy("node", "seg", following.alias("next")).agg(F.sum("n").alias("m")).join(names, (F.col("node") == F.col("c_node")) & (F.col("seg") == F.col("c_seg"))).groupBy("node", "g", "next").agg(F.sum("m").alias("m"))
        branches = merged(called, below).select(F.col("node").alias("m_node"), F.col("g").alias("m_g"), "branch")
        moved = names.join(branches, (F.col("c_node") == F.col("m_node")) & (F.col("g") == F.col("m_g"))).select("c_node", "c_seg", F.concat("c_node", "branch", F.lit("/")).alias("child"))
        here = counts.withColumn("seg", F.when(F.col("depth") >= level, F.element_at(parts, level)))
        joined = here.join(moved, (F.col("node") == F.col("c_node")) & (F.col("seg") == F.col("c_seg")), "left")
        counts = materialize(joined.withColumn("node", F.coalesce("child", "node")).select(counts.columns), "tree")
    rest = F.when(F.col("depth") > levels, F.array_join(F.slice(parts, levels + 1, F.greatest(F.col("depth") - levels, F.lit(0))), "/")).otherwise(F.lit(""))
    counts = counts.withColumn("template", F.concat("node", rest))
    own = counts.groupBy(F.col("template").alias("t")).agg(F.sum("blocked").alias("tb"), F.sum("labelled").alias("tl"))
    base = counts.agg((F.sum("blocked") / F.greatest(F.sum("labelled"), F.lit(1))).alias("base")).first()["base"] or 0.0
    own = own.withColumn("purity", (F.col("tb") + SMOOTHING * base) / (F.col("tl") + SMOOTHING))
    own = own.withColumn("rejected", (F.col("purity") >= REJECT_AT) & (F.col("tl") > 0))
    return counts.join(own, F.col("template") == F.col("t")).select("host", "shapes", "template", "purity", "rejected")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), template and purity of every page."""
    rows = shaped(ruled(parsed(pages.select("page_id", "url")), rules))
    found = templates(rows).select(F.col("host").alias("t_host"), F.col("shapes").alias("t_shapes"), "template", "purity", "rejected")
    verdict = F.coalesce("rule_verdict", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(found, (F.col("host") == F.col("t_host")) & (F.col("shapes") == F.col("t_shapes")), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def levels_sql(levels: int = 4) -> str:
    """The steps of ``judge`` in SQL for paths of at most ``levels`` segments, written from the description above."""
    rule = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}:{h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    steps = []
    for k in range(1, levels + 1):
        steps.append(f"""
k{k} AS (SELECT node, parts[{k}] AS seg, sum(n) AS n, sum(blocked) AS bl, sum(labelled) AS la FROM c{k - 1} WHERE len(parts) >= {k} GROUP BY ALL),
g{k} AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY node) <= {MAX_CHILDREN} OR (n >= {MIN_PAGES} AND (la > 0 OR n * {MIN_SHARE} >= sum(n) OVER (PARTITION BY node))) THEN seg ELSE '*' END AS g FROM k{k}),
s{k} AS (SELECT node, g, sum(bl) AS bl, sum(la) AS la, row_number() OVER (PARTITION BY node ORDER BY (sum(bl) + 0.5e0) / (sum(la) + 1e0), g) AS i FROM g{k} GROUP BY node, g),
p{k} AS (SELECT a.node, a.i, a.g, b.g AS pg, a.bl, a.la, b.bl AS pbl, b.la AS pla, (a.bl + b.bl) / nullif(a.la + b.la, 0)::DOUBLE AS pool FROM s{k} a JOIN s{k} b ON a.node = b.node AND b.i = a.i - 1 WHERE a.la > 0 AND b.la > 0),
z{k} AS (SELECT * FROM p{k} WHERE pool <= 0 OR pool >= 1 OR abs(bl / la::DOUBLE - pbl / pla::DOUBLE) < {Z_SAME} * sqrt(pool * (1 - pool) * (1 / la::DOUBLE + 1 / pla::DOUBLE))),
w{k} AS (SELECT node, g, coalesce(parts[{k + 1}], '') AS nx, sum(c.n) AS m FROM c{k - 1} c JOIN g{k} USING (node) WHERE parts[{k}] = seg GROUP BY ALL),
x{k} AS (SELECT node, i, nx, sum(a) AS a, sum(b) AS b FROM (SELECT z.node, z.i, nx, m AS a, 0 AS b FROM z{k} z JOIN w{k} w ON w.node = z.node AND w.g = z.g UNION ALL SELECT z.node, z.i, nx, 0, m FROM z{k} z JOIN w{k} w ON w.node = z.node AND w.g = z.pg) GROUP BY ALL),
y{k} AS (SELECT *, sum(a) OVER (PARTITION BY node, i)::DOUBLE AS ta, sum(b) OVER (PARTITION BY node, i)::DOUBLE AS tb FROM x{k}),
t{k} AS (SELECT node, i FROM y{k} GROUP BY node, i HAVING sum(power(a * sqrt(tb / ta) - b * sqrt(ta / tb), 2) / (a + b)) <= count(*) - 1 + 2 * sqrt(2 * (count(*) - 1)) + 1e-9),
b{k} AS (SELECT node, g, i, sum(CASE WHEN (node, i) IN (SELECT (node, i) FROM t{k}) THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY i) AS number FROM s{k}),
f{k} AS (SELECT node, g, first_value(g) OVER (PARTITION BY node, number ORDER BY i) AS branch FROM b{k}),
m{k} AS (SELECT node, seg, branch FROM g{k} JOIN f{k} USING (node, g)),
c{k} AS (SELECT host, shapes, parts, n, blocked, labelled, c.node || coalesce(branch || '/', '') AS node FROM c{k - 1} c LEFT JOIN m{k} m ON m.node = c.node AND m.seg = c.parts[{k}])""")
    return f"""
WITH urls AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
places AS (SELECT page_id,
  translate(regexp_extract(u, '{URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '{URL}', 2) AS path FROM urls),
decided AS (SELECT *, CASE {rule} END AS d,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')) AS parts FROM places),
rows0 AS (SELECT page_id, host, path, split_part(d, ':', 2) AS rule, split_part(d, ':', 1) AS rv, parts, array_to_string(parts, '/') AS shapes FROM decided),
c0 AS (SELECT host, shapes, any_value(parts) AS parts, count(*) AS n, count(*) FILTER (rv = 'block') AS blocked, count(*) FILTER (rv IN ('block', 'allow')) AS labelled, host || '/' AS node FROM rows0 GROUP BY host, shapes),{','.join(steps)},
base AS (SELECT sum(blocked) / greatest(sum(labelled), 1)::DOUBLE AS r FROM c{levels}),
own AS (SELECT node, (sum(blocked) + {SMOOTHING} * any_value(r)) / (sum(labelled) + {SMOOTHING}) >= {REJECT_AT} AND sum(labelled) > 0 AS rejected FROM c{levels}, base GROUP BY node)
SELECT page_id, rows0.host, path, rule, CASE WHEN rv IN ('allow', 'block') THEN rv WHEN rejected THEN 'block' ELSE 'allow' END AS verdict
FROM rows0 JOIN c{levels} USING (host, shapes) JOIN own USING (node)"""
