"""Queries of validation, comparison and text fields over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_queries import LAT, LNG, STOPS_SQL, at, long, metres_sql, query, stops, table
from .functions import extract, geo, text
from .operators import differences, enrichment, geometry, identity, quality, spatial
from .plans import places, planner, rebuild
from .sources import pages as page_source
from .streaming import state

#: SQL of segments with their metres and what lies before them, and of anchors (route, k, name, y, x) projected onto the segments of their route.
PARTS_SQL = """s AS (SELECT route, idx, lat, lng, lead(lat) OVER w AS nlat, lead(lng) OVER w AS nlng FROM p WINDOW w AS (PARTITION BY route ORDER BY idx)),
g AS (SELECT *, 2 * 6371000.0e0 * atan2(sqrt(h), sqrt(1 - h)) AS d FROM (SELECT *, sin(radians(nlat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(nlat)) * sin(radians(nlng - lng) / 2) ** 2 AS h FROM s WHERE nlat IS NOT NULL)),
c AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY route ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(d) OVER (PARTITION BY route) AS whole FROM g),
n AS (SELECT a.*, idx, d, before, whole, (lng - x) * 111320.0e0 * cos(radians(y)) AS x1, (lat - y) * 110540.0e0 AS y1, (nlng - x) * 111320.0e0 * cos(radians(y)) AS x2, (nlat - y) * 110540.0e0 AS y2 FROM a JOIN c USING (route)),
t AS (SELECT *, CASE WHEN (x2 - x1) ** 2 + (y2 - y1) ** 2 = 0 THEN 0 ELSE greatest(0, least(1, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) END AS u FROM n),
o AS (SELECT *, sqrt((x1 + u * (x2 - x1)) ** 2 + (y1 + u * (y2 - y1)) ** 2) AS off, (before + u * d) / whole AS progress FROM t),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route, k, name ORDER BY off, idx) AS r FROM o) WHERE r = 1)"""


@query(f"""
WITH {STOPS_SQL}, p AS (SELECT * FROM stops), a AS (SELECT s_suppkey % (SELECT max(route) + 1 FROM stops) AS route, s_suppkey AS k, '' AS name, {LAT.format('(s_suppkey * 11)')} AS y, {LNG.format('(s_suppkey * 11)')} AS x FROM supplier), {PARTS_SQL}
SELECT k AS anchor, CAST(route AS BIGINT) AS route, floor(off) AS metres_off, floor(progress * 1000 + 0.001e0) AS progress FROM m""")
def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors on the polyline of their route: distance and progress, most of them far off the line."""
    network = stops(spark, sf_dir)
    routes = network.agg(F.max("route") + 1).first()[0] or 1
    key = F.col("s_suppkey")
    rows = at(table(spark, sf_dir, "supplier").select(key.alias("anchor"), (key % routes).alias("route"), (key * 11).alias("p")), "p", "a_lat", "a_lng")
    found = spatial.onto_line(rows.drop("p"), spatial.segments(network, "route", "idx"), "route", "anchor")
    return found.select("anchor", long("route", "route"), F.floor("metres_off").cast("double").alias("metres_off"), F.floor(F.col("progress") * 1000 + 0.001).cast("double").alias("progress"))


@query(f"""
WITH {STOPS_SQL}, p AS (SELECT * FROM stops WHERE NOT (route % 13 = 0 AND idx >= 12)),
a AS (SELECT route, CASE WHEN route % 7 = 5 THEN -idx ELSE idx END AS k, 's' || name AS name, lat + CASE WHEN route % 7 = 3 AND idx IN (12, 18) THEN 0.01e0 ELSE 0.001e0 END AS y, lng AS x FROM stops WHERE idx % 3 = 0 AND NOT (route % 11 = 4 AND idx >= 9)), {PARTS_SQL},
np AS (SELECT route, count(*) AS n_points FROM p GROUP BY 1), na AS (SELECT route, count(*) AS n_anchors FROM a GROUP BY 1), whole AS (SELECT route, sum(d) AS metres FROM g GROUP BY 1),
f AS (SELECT m.* FROM m JOIN np USING (route) JOIN na USING (route) WHERE n_points >= 15 AND n_anchors >= 5),
off AS (SELECT route, name AS off_name, off AS off_metres FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY k, name) AS q FROM f WHERE off > 350) WHERE q = 1),
back AS (SELECT route, b AS back_from, progress AS back_to FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY k, name) AS q FROM (SELECT *, lag(progress) OVER (PARTITION BY route ORDER BY k, name) AS b FROM f WHERE off <= 350) WHERE progress < b - 0.05e0) WHERE q = 1),
most AS (SELECT route, max(off) AS most_off FROM f WHERE off <= 350 GROUP BY 1),
e AS (SELECT route, CASE route % 4 WHEN 0 THEN 20.0e0 WHEN 1 THEN 45.0e0 WHEN 3 THEN 0.0e0 END AS km FROM np)
SELECT CAST(route AS BIGINT) AS route, CAST(n_points AS BIGINT) AS n_points, CAST(coalesce(n_anchors, 0) AS BIGINT) AS n_anchors, floor(metres) AS metres, floor(most_off * 10) AS most_off, off_name, floor(off_metres) AS off_metres, floor(back_from * 1000 + 0.001e0) AS back_from, floor(back_to * 1000 + 0.001e0) AS back_to,
 CASE WHEN n_points < 15 THEN 'too_few_points' WHEN coalesce(n_anchors, 0) < 5 THEN 'too_few_anchors' WHEN off_metres IS NOT NULL THEN 'anchor_off_line' WHEN back_to IS NOT NULL THEN 'progress_not_monotone' WHEN nullif(km, 0) IS NOT NULL AND NOT metres / 1000 BETWEEN 0.6 * km AND 1.8 * km THEN 'length_out_of_range' END AS code
FROM np LEFT JOIN na USING (route) LEFT JOIN whole USING (route) LEFT JOIN off USING (route) LEFT JOIN back USING (route) LEFT JOIN most USING (route) LEFT JOIN e USING (route)""")
def q_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation of every route's line against every third of its stops, some of them moved, reversed or missing."""
    network, route, idx = stops(spark, sf_dir), F.col("route"), F.col("idx")
    points = network.where(~((route % 13 == 0) & (idx >= 12))).select("route", idx.alias("at"), "lat", "lng")
    moved = F.when((route % 7 == 3) & idx.isin(12, 18), F.lit(0.01)).otherwise(F.lit(0.001))
    kept = network.where((idx % 3 == 0) & ~((route % 11 == 4) & (idx >= 9)))
    anchors = kept.select("route", F.when(route % 7 == 5, -idx).otherwise(idx).alias("at"), F.concat(F.lit("s"), F.col("name").cast("string")).alias("name"), (F.col("lat") + moved).alias("lat"), "lng")
    expected = network.select("route").distinct().withColumn("kilometres", F.when(route % 4 == 0, F.lit(20.0)).when(route % 4 == 1, F.lit(45.0)).when(route % 4 == 3, F.lit(0.0)))
    found = geometry.validated(points, anchors, "route", expected)
    # the ends of a line lie at whole thousandths, which rounding must not cross
    whole = lambda c, k=1: F.floor(F.col(c) * k + (0.001 if k == 1000 else 0.0)).cast("double").alias(c)
    return found.select(long("route", "route"), long("n_points", "n_points"), long("n_anchors", "n_anchors"), whole("metres"), whole("most_off", 10), "off_name", whole("off_metres"), whole("back_from", 1000), whole("back_to", 1000), "code")


@query("""
WITH e AS (SELECT event_id, user_id, ts, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), ts, event_id) AS after FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT event_id, user_id FROM e WHERE after IS NULL OR after - epoch_ms(ts) >= 3600000""")
def q_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after which their user is quiet for an hour."""
    return state.debounced(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3_600_000).select("event_id", "user_id")


@query("""
WITH e AS (SELECT event_id, event_id // 30 AS k, event_id % 3 <> 0 AS answer, event_id % 30 // 6 AS n, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN ms - before > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY us, answer), 0) AS stretch FROM (SELECT *, lag(ms) OVER (PARTITION BY k ORDER BY us, answer) AS before FROM e)),
w AS (SELECT *, max(CASE WHEN NOT answer THEN n END) OVER (PARTITION BY k, stretch ORDER BY us, answer) AS newest FROM s)
SELECT event_id, CAST(n AS BIGINT) AS n FROM w WHERE answer AND n = newest""")
def q_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to the newest request of their group of thirty events."""
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 30").alias("k"), F.when(key % 3 == 0, F.lit("request")).otherwise(F.lit("response")).alias("kind"), F.expr("event_id % 30 div 6").alias("n"), "ts")
    return state.fresh_of(rows, "k", "kind", "n", "ts", 3_600_000_000).select("event_id", long("n", "n"))


@query("""
WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
d AS (SELECT k, n, CASE WHEN k % 23 = 6 THEN 'only_stored' WHEN k % 23 = 7 THEN 'only_computed' ELSE 'changed' END AS drift,
 CASE WHEN k % 23 IN (6, 7) THEN '' ELSE concat_ws(',', CASE WHEN k % 17 = 5 THEN 'counts' WHEN k % 5 = 1 THEN 'counts.qty' END, CASE WHEN k % 11 = 3 THEN 'lines.size' END, CASE WHEN k % 7 = 2 AND NOT (k % 11 = 3 AND n = 1) THEN 'lines[0].price' END, CASE WHEN k % 13 = 4 THEN 'flags.extra' END, CASE WHEN k % 3 = 0 THEN 'flags.few' END) END AS paths FROM l)
SELECT k AS key, drift, paths FROM d WHERE drift <> 'changed' OR paths <> ''""")
def q_nested_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nested counts, lines and flags against changed forms of themselves; the time of evaluation always differs and doesn't count."""
    k = F.col("key")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_extendedprice").cast("double").alias("price")))).alias("lines"))

    def form(changed: bool) -> DataFrame:
        if_ = lambda test, then, other: F.when(test, then).otherwise(other) if changed else other
        counts = F.struct("n", if_(k % 5 == 1, F.col("qty").cast("double") + 1, F.col("qty").cast("double")).alias("qty"))
        dearer = F.transform("lines", lambda x, i: F.struct(x["number"].alias("number"), F.when(i == 0, x["price"] + 1).otherwise(x["price"] + 0.001).alias("price")))
        lines = if_(k % 7 == 2, dearer, F.col("lines"))
        lines = if_(k % 11 == 3, F.slice(lines, F.lit(1), F.size(lines) - 1), lines)
        flags = F.create_map(F.lit("few"), if_(k % 3 == 0, F.lit(0), F.lit(1)))
        flags = if_(k % 13 == 4, F.map_concat(flags, F.create_map(F.lit("extra"), F.lit(2))), flags)
        whole = [F.lit("now" if changed else "then").alias("evaluatedAt"), if_(k % 17 == 5, F.lit(None), counts).alias("counts"), lines.alias("lines"), flags.alias("flags")]
        return rows.where(k % 23 != (6 if changed else 7)).select("key", *whole)

    found = differences.nested_drift(form(False), form(True), ["key"], ["evaluatedAt"], 0.01)
    return found.select("key", "drift", F.array_join("differences.path", ",").alias("paths"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[^A-Za-z0-9:/._-]', '', 'g') AS u FROM pages)
SELECT page_id, CAST(0 AS BIGINT) AS "table", CAST(NULL AS BIGINT) AS around, CAST(0 AS BIGINT) AS "row", 'No|Page' AS cells FROM p
UNION ALL SELECT page_id, 0, NULL, 1, page_id || '|' || u || ' & in' || page_id % 7 || 'tail' FROM p
UNION ALL SELECT page_id, 1, 0, 0, 'in' || page_id % 7 FROM p
UNION ALL SELECT page_id, 1, 0, 1, 'x|' FROM p WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 0, NULL, 2, 'end' FROM p
UNION ALL SELECT page_id, 2, NULL, 0, 'after' FROM p WHERE page_id % 3 = 0""")
def q_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of nested tables with unclosed rows and cells, made up from each page's number and address."""
    key, s = F.col("page_id"), lambda c: c.cast("string")
    plain = F.regexp_replace(F.coalesce("url", F.lit("")), "[^A-Za-z0-9:/._-]", "")
    inner = F.concat(F.lit("<table class='a'><tr><td>in"), s(key % 7), F.when(key % 2 == 0, F.lit("<tr><th>")).otherwise(F.lit("")), F.when(key % 2 == 0, F.lit("x<td></table>")).otherwise(F.lit("</td></tr></table>")))
    # the text of the nested table belongs to the outer cell as well, so its second row is left out of it there
    html = F.concat(F.lit("<p><TABLE><thead><tr><th>No<th> Page </thead><tbody><tr><td>"), s(key), F.lit("<td>"), plain, F.lit(" &amp;&nbsp;"), inner, F.lit("tail<tr><td><b>end</b></tbody>"), F.when(key % 3 == 0, F.lit("</table><table><td>after")).otherwise(F.lit("")))
    rows = page_source.table_rows(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id")
    cells = F.transform("cells", lambda c: F.when((F.col("table") == 0) & (key % 2 == 0), F.regexp_replace(c, "(in[0-9])x", "$1")).otherwise(c))
    return rows.select("page_id", long("table", "table"), long("around", "around"), long("row", "row"), F.array_join(cells, "|").alias("cells"))


@query(r"""
WITH p AS (SELECT p_partkey AS k, p_size AS z, '2024-' || lpad(CAST(1 + p_size % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + p_partkey % 31 AS VARCHAR), 2, '0') AS begin FROM part),
h AS (SELECT *, CASE WHEN z % 4 > 1 THEN (z % 4 - 1) * 10 WHEN z % 3 > 0 THEN z % 3 * 15 END AS headway FROM p)
SELECT k AS p_partkey, regexp_replace(lpad(CAST(z % 40 AS VARCHAR), 2, '0') || ' ' || (k % 100) || ' Le', '^(?:(?:0[1-9]|[12][0-9])\s*)+', '') AS label,
 CASE k % 3 WHEN 0 THEN 'B' || z WHEN 1 THEN 'X -' ELSE 'plain ' || z END AS tail,
 'A - B' || CASE k % 4 WHEN 0 THEN ' C - D' WHEN 3 THEN ' C -' ELSE '' END AS path,
 CASE k % 5 WHEN 0 THEN 'Thaco' WHEN 1 THEN 'GAZ' WHEN 2 THEN 'Xe buýt điện' ELSE 'Chưa có dữ liệu' END AS brand, CASE k % 5 WHEN 0 THEN z || ' chỗ' ELSE '' END AS capacity,
 CASE k % 5 WHEN 0 THEN z || ' chỗ' WHEN 2 THEN 'Xe buýt điện' WHEN 4 THEN 'Phương tiện' ELSE 'Xe buýt' END AS description,
 CAST((k % 1440 + headway) % 1440 AS BIGINT) AS following,
 CASE WHEN try_cast(begin AS DATE) IS NULL THEN 'invalid_date' WHEN begin > '2024-06-15' THEN 'reversed' WHEN k % 7 = 0 THEN 'unproven' END AS problem FROM h""")
def q_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges, tails, continued paths, vehicles, following departures and override dates in forms that differ by a part's key and size."""
    k, z, s = F.col("p_partkey"), F.col("p_size"), lambda c: c.cast("string")
    two = lambda c: F.lpad(s(c), 2, "0")
    ends = F.when(k % 3 == 0, F.concat(F.lit("A - B"), s(z))).when(k % 3 == 1, F.lit("X -")).otherwise(F.concat(F.lit("plain "), s(z)))
    more = F.when(k % 4 == 0, F.lit("C - D")).when(k % 4 == 1, F.lit("STT")).when(k % 4 == 2, F.lit("7. C")).otherwise(F.lit("C - 1D"))
    bus = F.when(k % 5 == 0, F.concat(F.lit("Nhãn hiệu: Thaco; Sức chứa: "), s(z), F.lit(" chỗ"))).when(k % 5 == 1, F.lit("GAZelle")).when(k % 5 == 2, F.lit("xe ĐIỆN")).when(k % 5 == 3, F.lit("xe"))
    begin = F.concat(F.lit("2024-"), two(1 + z % 12), F.lit("-"), two(1 + k % 31))
    vehicle, path = extract.vehicle(bus), extract.paths(F.concat(F.lit("Chiều đi: A - B\n"), more, F.lit("\nChiều về: B")))
    out = [extract.without_badge(F.concat(two(z % 40), F.lit(" "), s(k % 100), F.lit(" Le"))).alias("label"), extract.last_part(ends).alias("tail"), path["outbound"].alias("path"), *[vehicle[c].alias(c) for c in ("brand", "capacity", "description")]]
    following = extract.following_departure(k % 1440, (z % 4 - 1) * 10, z % 3 * 15)
    return table(spark, sf_dir, "part").select("p_partkey", *out, long(following, "following"), extract.override_problem(begin, F.lit("2024-06-15"), k % 7 > 0).alias("problem"))


@query(f"""
WITH q AS (SELECT s_suppkey AS query_id, lower(CASE s_suppkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN split_part(p_name, ' ', 2) ELSE p_type END) AS q FROM supplier JOIN part ON p_partkey = s_suppkey),
p AS (SELECT p_partkey AS place_id, lower(p_name) AS name, lower(p_type) AS address, lower(split_part(p_name, ' ', 2)) AS key, {LAT.format('p_partkey')} AS lat, {LNG.format('p_partkey')} AS lng FROM part),
h AS (SELECT query_id, place_id, CASE WHEN starts_with(name, q) THEN 100 WHEN contains(name, q) THEN 80 ELSE 50 END AS score FROM q JOIN p ON len(q) >= 2 AND (contains(name, q) OR contains(address, q) OR contains(key, q) OR contains(q, key))),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, format('{{:.4f}}', lat), format('{{:.4f}}', lng) ORDER BY score DESC, place_id) AS first FROM h JOIN p USING (place_id))
SELECT query_id, place_id, CAST(score AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place_id) AS rank FROM f WHERE first = 1) WHERE rank <= 8""")
def q_place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, words of them or types, one query for each supplier, looked for in all parts' names, types and second words."""
    part, key, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("s_suppkey")
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    points = at(part.select(key.alias("place_id"), F.col("p_name").alias("name"), F.col("p_type").alias("address"), F.array(word(2)).alias("keywords"), key.alias("ordinal")), "place_id")
    query = F.when(s % 4 == 0, F.col("p_name")).when(s % 4 == 1, word(1)).when(s % 4 == 2, word(2)).otherwise(F.col("p_type"))
    asked = table(spark, sf_dir, "supplier").join(part, s == key).select(s.alias("query_id"), query.alias("query"))
    stops = points.drop("keywords").limit(0)
    return places.search(asked, points, stops).select("query_id", "place_id", long("score", "score"), long("rank", "rank"))


@query("""
WITH s AS (SELECT c_custkey // 30 AS route, c_custkey % 2 = 0 AS outbound, c_custkey % 30 < 20 AND c_custkey // 30 % 3 < 2 AND (c_custkey % 2 = 0 OR c_custkey // 30 % 2 = 0) AS shaped, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS street FROM customer)
SELECT CAST(route AS BIGINT) AS route, CAST(count(*) FILTER (outbound) AS BIGINT) AS outbound_stops, CAST(count(*) FILTER (NOT outbound) AS BIGINT) AS inbound_stops, coalesce(bool_or(shaped AND outbound), false) AS outbound_geometry, coalesce(bool_or(shaped AND NOT outbound), false) AS inbound_geometry,
 coalesce(string_agg(DISTINCT street, '|' ORDER BY street), '') AS streets FROM s GROUP BY route""")
def q_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact summary of routes of thirty customers, with shapes for some of their directions."""
    key, route = F.col("c_custkey"), F.expr("c_custkey div 30")
    rows = table(spark, sf_dir, "customer").select(route.alias("route"), F.when(key % 2 == 0, F.lit("outbound")).otherwise(F.lit("inbound")).alias("direction"), (key % 30).alias("at"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("street"))
    r = F.col("route")
    points = rows.where((F.col("at") < 20) & (r % 3 < 2) & ((F.col("direction") == "outbound") | (r % 2 == 0)))
    found = rebuild.compact(rows.select("route").distinct(), rows, points, rows)
    return found.select(long("route", "route"), long("outbound_stops", "outbound_stops"), long("inbound_stops", "inbound_stops"), "outbound_geometry", "inbound_geometry", F.array_join("streets", "|").alias("streets"))


@query("""
WITH q AS (SELECT s_suppkey AS query_id, lower(CASE s_suppkey % 3 WHEN 0 THEN p_name || ' xyz' WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_type END) AS q FROM supplier JOIN part ON p_partkey = s_suppkey),
p AS (SELECT p_partkey AS place_id, lower(p_name) AS name, lower(p_type) AS address FROM part),
h AS (SELECT query_id, place_id FROM q JOIN p ON contains(name, q) OR contains(q, name) OR contains(address, q))
SELECT query_id, min(place_id) AS place_id FROM h GROUP BY query_id""")
def q_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that a text names: one query for each supplier, longer or shorter than names."""
    part, key, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("s_suppkey")
    points = at(part.select(key.alias("place_id"), F.col("p_name").alias("name"), F.col("p_type").alias("address"), F.array().cast("array<string>").alias("keywords"), key.alias("ordinal")), "place_id")
    query = F.when(s % 3 == 0, F.concat("p_name", F.lit(" xyz"))).when(s % 3 == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_type"))
    asked = table(spark, sf_dir, "supplier").join(part, s == key).select(s.alias("query_id"), query.alias("query"))
    stops = points.drop("keywords").limit(0).withColumn("status", F.lit("verified"))
    return places.looked_up(asked, points, stops).select("query_id", "place_id")


@query("""
WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 50 WHEN 7 THEN NULL WHEN 9 THEN p_partkey - 1 ELSE p_partkey END AS id, CASE WHEN p_partkey % 10 IN (1, 2, 3) THEN p_partkey + 1 WHEN p_partkey % 10 = 4 THEN p_partkey - 3 WHEN p_partkey % 10 = 6 THEN -p_partkey END AS next FROM part),
m AS (SELECT max(p_partkey) AS most FROM part)
SELECT 'missing_id' AS issue, NULL AS kind, NULL AS id FROM p WHERE id IS NULL
UNION ALL SELECT 'duplicate_id', NULL, CAST(id AS VARCHAR) FROM p WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'broken_reference', 'superseded_by', CAST(id AS VARCHAR) FROM p WHERE next IS NOT NULL AND next NOT IN (SELECT id FROM p WHERE id IS NOT NULL)
UNION ALL SELECT 'reference_cycle', 'superseded_by', CAST(id AS VARCHAR) FROM p, m WHERE k % 10 BETWEEN 1 AND 4 AND k - k % 10 + 4 <= most""")
def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of identifiers and references: missing and double ids, links to nothing, and circles of four."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.when(k % 50 == 7, F.lit(None)).when(k % 50 == 9, k - 1).otherwise(k).alias("id"), F.when((k % 10).isin(1, 2, 3), k + 1).when(k % 10 == 4, k - 3).when(k % 10 == 6, -k).alias("next"))
    return identity.audit(rows.select("id"), {"superseded_by": rows}).select("issue", "kind", "id")


@query(f"""
WITH c AS (SELECT c_custkey AS k, {LAT.format('c_custkey')} AS y, {LNG.format('c_custkey')} AS x FROM customer),
e AS (SELECT k, CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN 95.0e0 WHEN 2 THEN 10.0e0 ELSE y END AS y1, x AS x1, CASE k % 9 WHEN 3 THEN y + 0.0001e0 WHEN 4 THEN 16.349e0 WHEN 5 THEN 16.351e0 WHEN 6 THEN 15.4e0 ELSE y - 0.01e0 END AS y2, CASE k % 9 WHEN 7 THEN 181.0e0 ELSE x END AS x2 FROM c)
SELECT k AS c_custkey, CASE WHEN y1 IS NULL THEN 'INVALID_ENDPOINTS' WHEN abs(y1) > 90 OR abs(x2) > 180 THEN 'INVALID_COORDINATES' WHEN NOT y1 BETWEEN 15.40 AND 16.35 OR NOT y2 BETWEEN 15.40 AND 16.35 OR NOT x1 BETWEEN 107.90 AND 108.65 OR NOT x2 BETWEEN 107.90 AND 108.65 THEN 'OUT_OF_SERVICE_AREA'
 WHEN {metres_sql('y1', 'x1', 'y2', 'x2')} < 50 THEN 'SAME_LOCATION' END AS code FROM e""")
def q_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's verdict on pairs of ends: missing, impossible, outside, equal or fine."""
    k, y, x = F.col("c_custkey"), F.col("lat"), F.col("lng")
    rows = at(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    y1 = F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, F.lit(95.0)).when(k % 9 == 2, F.lit(10.0)).otherwise(y)
    y2 = F.when(k % 9 == 3, y + 0.0001).when(k % 9 == 4, F.lit(16.349)).when(k % 9 == 5, F.lit(16.351)).when(k % 9 == 6, F.lit(15.4)).otherwise(y - 0.01)
    return rows.select("c_custkey", planner.code(y1, x, y2, F.when(k % 9 == 7, F.lit(181.0)).otherwise(x)).alias("code"))


@query(f"""
WITH c AS (SELECT c_nationkey AS nation, {LAT.format('c_custkey')} AS lat, {LNG.format('c_custkey')} AS lng, c_custkey % 9 AS m FROM customer),
l AS (SELECT *, CASE WHEN lat >= 15.90 THEN 'Đà Nẵng, Việt Nam' WHEN m = 0 THEN 'Hội An, Quảng Nam, Việt Nam' WHEN m = 1 OR lat <= 15.65 THEN 'Tam Kỳ, Quảng Nam, Việt Nam' ELSE 'Quảng Nam, Việt Nam' END AS locality FROM c)
SELECT nation, locality, count(*) AS n, min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east FROM l WHERE m <> 5 GROUP BY ALL""")
def q_localities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation by locality, with the box around them; every ninth has no valid place."""
    k = F.col("c_custkey")
    rows = at(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), "c_custkey")
    street = F.when(k % 9 == 0, F.lit("Đường CỬA ĐẠI")).when(k % 9 == 1, F.lit("Núi Thành")).otherwise(F.lit("x"))
    named = rows.withColumn("locality", geo.locality(F.col("lat"), street)).withColumn("lat", F.when(k % 9 != 5, F.col("lat")).otherwise(F.lit(99.0)))
    found = named.groupBy("nation", "locality").agg(F.count_if(F.col("lat") < 90).alias("n"), *geo.bounds())
    return found.where(F.col("n") > 0).select("nation", "locality", "n", "south", "west", "north", "east")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)
SELECT doc_id, part, CAST(place AS BIGINT) AS "at", md5(line) AS line FROM l, (VALUES ('head', 1, 2), ('body', 2, 4), ('none', 5, 4)) AS r(part, a, b) WHERE doc_id % 3 < 2 AND place BETWEEN a + doc_id % 2 AND b""")
def q_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by ranges that overlap, or are empty."""
    docs = table(spark, sf_dir, "documents")
    ranges = docs.where(F.col("doc_id") % 3 < 2).select("doc_id", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), (F.lit(a) + F.col("doc_id") % 2).alias("first_line"), F.lit(b).alias("last_line")) for p, a, b in (("head", 1, 2), ("body", 2, 4), ("none", 5, 4))])))
    return page_source.line_ranges(docs, ranges, "doc_id", "text").select("doc_id", "part", long("at", "at"), F.md5("line").alias("line"))


@query(f"""
WITH {STOPS_SQL}, r AS (SELECT route, {LAT.format('(route * 30 + 7)')} + 0.002e0 AS y1, {LNG.format('(route * 30 + 7)')} AS x1, {LAT.format('(route * 30 + 20 - route % 3 * 9)')} AS y2, {LNG.format('(route * 30 + 20 - route % 3 * 9)')} + 0.001e0 AS x2 FROM (SELECT DISTINCT route FROM stops)),
d AS (SELECT route, idx, (lat - y1) * (lat - y1) + (lng - x1) * (lng - x1) AS a, (lat - y2) * (lat - y2) + (lng - x2) * (lng - x2) AS b FROM stops JOIN r USING (route)),
n AS (SELECT route, CAST(min((a, idx))[2] AS BIGINT) AS first_at, CAST(min((b, idx))[2] AS BIGINT) AS last_at FROM d GROUP BY route)
SELECT CAST(route AS BIGINT) AS route, first_at, last_at, CASE WHEN last_at >= first_at THEN last_at - first_at + 1 END AS n_points FROM n""")
def q_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each route's line between the vertices nearest to two places; none where that runs backwards."""
    lines = stops(spark, sf_dir).groupBy("route").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lng"))).alias("points"))
    r = F.col("route")
    (y1, x1), (y2, x2) = geo.fallback_position(r * 30 + 7), geo.fallback_position(r * 30 + 20 - r % 3 * 9)
    first, last = spatial.nearest_vertex(F.col("points"), y1 + 0.002, x1), spatial.nearest_vertex(F.col("points"), y2, x2 + 0.001)
    rows = lines.select("route", "points", first.alias("first_at"), last.alias("last_at"))
    return rows.select(long("route", "route"), long("first_at", "first_at"), long("last_at", "last_at"), long(F.size(spatial.between_vertices(F.col("points"), F.col("first_at"), F.col("last_at"))), "n_points"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 7 AS m FROM part), b AS (SELECT *, CASE WHEN m IN (0, 3) THEN NULL ELSE z END AS low, CASE WHEN m IN (1, 3) THEN NULL ELSE z + m % 3 END AS high, CASE WHEN m = 0 THEN z + 2 END AS peak FROM p), f AS (SELECT *, coalesce(low, peak) AS a, high AS h FROM b)
SELECT k AS p_partkey, CASE WHEN m = 5 THEN CASE WHEN k % 2 = 0 THEN 'Theo lịch bay' ELSE 'Giờ không cố định' END WHEN a <> h THEN a || '-' || h || ' phút' WHEN coalesce(a, h) IS NOT NULL THEN coalesce(a, h) || ' phút' ELSE 'Đang cập nhật' END AS frequency,
 CASE WHEN m = 4 THEN 'Đang cập nhật' ELSE lpad(CAST(z % 24 AS VARCHAR), 2, '0') || ':05 - ' || CASE WHEN m = 2 THEN 'tối' ELSE '21:30' END END AS hours,
 CAST(CASE WHEN z % 30 < 24 THEN z % 30 * 60 + 5 END AS BIGINT) AS minutes, lpad(CAST((k * 7 % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k * 7 % 60 AS VARCHAR), 2, '0') AS clock FROM f""")
def q_schedule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies, operating hours and times of day as texts, with parts of them missing."""
    k, z, m = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 7
    low, high = F.when(~m.isin(0, 3), z), F.when(~m.isin(1, 3), z + (m % 3).cast("int"))
    frequency = text.frequency_text(low, high, F.when(m == 0, z + 2), F.lit(None).cast("int"), m == 5, F.when(k % 2 == 0, F.lit("theo giờ BAY")))
    hours = text.hours_text(F.when(m != 4, F.concat((z % 24).cast("string"), F.lit(":5"))).otherwise(F.lit("")), F.when(m == 2, F.lit("tối")).otherwise(F.lit("21:30")))
    minutes = text.minutes_of(F.concat((z % 30).cast("string"), F.lit(":05")))
    return table(spark, sf_dir, "part").select("p_partkey", frequency.alias("frequency"), hours.alias("hours"), long(minutes, "minutes"), text.clock(k * 7 + 1440).alias("clock"))


@query("""
WITH r AS (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN 'large' WHEN p_type LIKE '%STEEL%' OR p_type = 'ECONOMY' THEN 'steel' ELSE 'other' END AS class FROM part)
SELECT class, CAST(count(*) AS BIGINT) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM part), 2) AS pct, md5(string_agg(CAST(k AS VARCHAR), ',' ORDER BY -k)) AS ids FROM r GROUP BY class""")
def q_coverage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of parts with their share and the ids of their members, in falling order."""
    classes = [(F.col("p_size") > 40, "large"), (F.col("p_type").contains("STEEL") | (F.col("p_type") == "ECONOMY"), "steel")]
    found = quality.coverage_lists(table(spark, sf_dir, "part").withColumn("ordinal", -F.col("p_partkey")), "p_partkey", classes, "ordinal")
    return found.select("class", long("n", "n"), "pct", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS m FROM orders)
SELECT k AS o_orderkey, CASE WHEN m IN (1, 2) THEN 'https://example.org/' || k END AS source_url, CASE WHEN m = 1 THEN '2024-01-0' || (1 + k % 9) END AS last_verified_at, CASE WHEN m = 1 THEN 'verified' WHEN m = 2 THEN 'pending' ELSE 'unverified' END AS verification_status, CASE WHEN m = 1 THEN o_orderpriority END AS kept
FROM o JOIN orders ON o_orderkey = k""")
def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the provenance of their entry, where they have one; a field of those that aren't verified is emptied."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 5
    orders = table(spark, sf_dir, "orders")
    entries = orders.where(m.isin(1, 2, 3)).select("o_orderkey", F.when(m < 3, F.concat(F.lit("https://example.org/"), k.cast("string"))).alias("source_url"), F.when(m == 1, F.concat(F.lit("2024-01-0"), (1 + k % 9).cast("string"))).alias("last_verified_at"), F.when(m == 1, F.lit("verified")).when(m == 2, F.lit("pending")).alias("verification_status"))
    rows = enrichment.with_provenance(orders.select("o_orderkey", F.col("o_orderpriority").alias("kept")), entries, "o_orderkey")
    rows = enrichment.materialised(rows, F.col("verification_status") == "verified", ["kept"])
    return rows.select("o_orderkey", "source_url", "last_verified_at", "verification_status", "kept")
