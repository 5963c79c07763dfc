"""Marked-up text, JSON columns, dictionary codes and composed views bound to the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import aggregates, filters, graph, joins, ranking
from tessera.operators.common import shared_folder
from tessera.plans import entities, indicators, linkage
from tessera.queries.registry import query, read
from tessera.queries.text import PLACE, placed
from tessera.sources import codec, tables
from tessera.streaming import windows

_ITEMS = "SELECT page_id, unnest(range(len(m)))::INT AS pos, trim(regexp_replace(replace(replace(regexp_replace(unnest(m), '<[^>]+>', ' ', 'gs'), '&nbsp;', ' '), '　', ' '), '\\s+', ' ', 'g')) AS item FROM (SELECT page_id, regexp_extract_all(html, '(?is)<{0}\\b[^>]*>(.*?)</{0}>', 1) AS m FROM pages)"


@query(_ITEMS.format("li"))
def html_items(spark, sf_dir):
    return tables.html_items(read(spark, sf_dir, "pages"), "page_id", "html", "li")


@query(_ITEMS.format("a"))
def html_links(spark, sf_dir):
    return tables.html_items(read(spark, sf_dir, "pages"), "page_id", "html", "a")


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return tables.json_fields(read(spark, sf_dir, "events"), "props", "k string").select("event_id", "event_type", "k")


@query("SELECT p_partkey, p_brand FROM part")
def dict_encode_roundtrip(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    codes = codec.dictionary(p, "p_brand", "p_partkey")
    return codec.decode(codec.encode(p, "p_brand", codes), "p_brand", codes)


@query("WITH f AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1) SELECT p_brand, row_number() OVER (ORDER BY first, p_brand) - 1 AS code FROM f")
def dictionary_codes(spark, sf_dir):
    return codec.dictionary(read(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("WITH c AS (SELECT count(*) AS rows, count(DISTINCT p_name) AS a, count(DISTINCT p_brand) AS b, count(DISTINCT p_partkey) AS c FROM part) SELECT 'p_name' AS \"column\", rows, a AS uniq, a * 3 < rows AS encode FROM c UNION ALL SELECT 'p_brand', rows, b, b * 3 < rows FROM c UNION ALL SELECT 'p_partkey', rows, c, c * 3 < rows FROM c")
def encoding_choice(spark, sf_dir):
    return codec.worth_encoding(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_partkey"])


@query("SELECT count(*) AS refs, count(DISTINCT m) AS uniq, count(DISTINCT m) * 2 < count(*) AS encode FROM (SELECT unnest(string_split(p_name, ' ')) AS m FROM part)")
def list_encoding_choice(spark, sf_dir):
    return codec.worth_encoding_list(read(spark, sf_dir, "part").select(F.split("p_name", " ").alias("m")), "m")


@query("SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def split_table(spark, sf_dir):
    out = codec.split_by(read(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"])
    return out.select("n_regionkey", F.array_join(F.transform("rows", lambda r: r["n_nationkey"].cast("string")), ",").alias("keys"))


@query("SELECT p_partkey, coalesce(p_name, p_brand) AS title, p_size AS amount, NULL AS missing FROM part")
def bound_columns(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return tables.bind_columns(p, {"p_partkey": ["p_partkey"], "title": ["title", "p_name", "p_brand"], "amount": ["p_size"], "missing": ["none"]})


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'a') AND contains(p_name, 'e') THEN 'ae' WHEN contains(p_name, 'o') THEN 'o' ELSE 'other' END AS kind FROM part")
def table_kinds(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", tables.table_kind(F.col("p_name"), [(["a", "e"], "ae"), (["o"], "o")], "other").alias("kind"))


@query("SELECT s_suppkey AS k, 1 AS rings, 3 AS points FROM supplier")
def polygons(spark, sf_dir):
    s = placed(read(spark, sf_dir, "supplier"), "s_suppkey")
    p = F.concat_ws(",", F.col("lng").cast("string"), F.col("lat").cast("string"))
    text = F.concat(p, F.lit(";113.5,23.5;113.6,23.6|113,23;114,24"))
    rings = s.select(F.col("s_suppkey").alias("k"), tables.polygon(text).alias("r"))
    return rings.select("k", F.size("r").alias("rings"), F.size(F.col("r")[0]).alias("points"))


@query("SELECT (event_id // 50)::BIGINT AS page, floor(value / 10)::BIGINT AS band, string_agg(event_type, '' ORDER BY event_id) AS event_type FROM events GROUP BY 1, 2")
def positioned_words(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("page"), "event_id", (F.floor(F.col("value") / 10) * 3.0).alias("y"), "event_type")
    return tables.words_to_rows(e, "page", "event_id", "y", "event_type")


@query("WITH a AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_suppkey, l_partkey, min(l_extendedprice) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), m AS (SELECT *, CASE WHEN n IS NULL THEN 'score' WHEN score IS NULL THEN 'quota' ELSE 'both' END AS source FROM a FULL JOIN b USING (l_suppkey, l_partkey) UNION ALL SELECT l_suppkey, l_partkey, count(*), NULL, 'district' FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY coalesce(n, 0) DESC, l_partkey, source) AS place FROM m")
def view_linkage(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    count = lambda flag: l.filter(F.col("l_returnflag") == flag).groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    score = l.filter("l_returnflag = 'R'").groupBy("l_suppkey", "l_partkey").agg(F.min("l_extendedprice").alias("score"))
    return indicators.linkage(count("A"), score, count("N"), ["l_suppkey", "l_partkey"], "n", "score")


@query("WITH o AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1) SELECT c_custkey, c_name, orders FROM customer LEFT JOIN o ON c_custkey = o_custkey")
def view_detail(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    out = indicators.detail(read(spark, sf_dir, "customer"), "c_custkey", {"orders": o}, ["o_orderkey"])
    return out.select("c_custkey", "c_name", F.array_join(F.transform("orders", lambda r: r["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT s_suppkey, 'nation=' || coalesce(n_name, '未查到') || ';key=' || s_suppkey::VARCHAR AS card FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 12")
def view_info_card(spark, sf_dir):
    n = read(spark, sf_dir, "nation").filter("n_nationkey < 12").withColumnRenamed("n_nationkey", "s_nationkey")
    s = joins.lookup(read(spark, sf_dir, "supplier"), n, "s_nationkey")
    out = indicators.info_card(s, [("nation", F.col("n_name")), ("key", F.col("s_suppkey"))])
    return out.select("s_suppkey", F.array_join(F.transform("signals", lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";").alias("card"))


@query(
    """WITH w AS (SELECT event_id // 50 AS page, event_id, (event_id % 4) * 70.0 AS x, floor(value / 10) * 3.0 AS y, CASE WHEN event_id % 4 = 3 THEN (event_id % 10000)::VARCHAR ELSE event_type END AS t FROM events)
 SELECT page, round_even(y / 3, 0)::BIGINT AS band, coalesce(string_agg(t, '' ORDER BY y, event_id) FILTER (WHERE x < 180), '') AS name, min_by(t, event_id) FILTER (WHERE x >= 180)::INT AS count FROM w GROUP BY 1, 2"""
)
def name_counts(spark, sf_dir):
    third = F.col("event_id") % 4
    text = F.when(third == 3, (F.col("event_id") % 10000).cast("string")).otherwise(F.col("event_type"))
    e = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("page"), "event_id", (third * 70.0).alias("x"), (F.floor(F.col("value") / 10) * 3.0).alias("y"), text.alias("t"))
    return tables.name_counts(e, "page", "event_id", "x", "y", "t")


@query("SELECT 2024 + c_custkey % 3 AS year, 'high' AS stage, c_custkey AS n, c_name AS school, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment ELSE '' END AS award FROM customer WHERE c_custkey % 3 < 2 AND c_custkey >= 5 * (1 + c_custkey % 3)")
def laid_out(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 3 + 2024).alias("year"), F.lit("high").alias("stage"), F.col("c_custkey").alias("n"), F.when(F.col("c_custkey") % 3 == 0, F.array("c_mktsegment", F.concat(F.lit(" "), "c_name"))).otherwise(F.array("c_name")).alias("cells"))
    layouts = {(2024, None): ({"school": 1, "award": 0}, 5), (2025, "high"): ({"school": 0}, 10), (2025, None): ({"school": 7}, 0)}
    return tables.laid_out(c, "cells", "n", "year", "stage", layouts, "school")


@query(
    """WITH p AS (SELECT p_partkey, p_size, p_type, replace(p_name, ' ', '') AS core, p_size % 2 = 1 AS odd, count(*) OVER (PARTITION BY p_type, p_size, p_name) AS n FROM part WHERE p_size <> 8),
 e AS (SELECT *, core || CASE WHEN odd THEN '东校区' ELSE '' END AS norm FROM p), k AS (SELECT *, 'gz-' || p_size || '-' || substr(sha1(p_size || '|' || norm), 1, 8) AS id FROM e)
 SELECT id, p_type AS stage, min(p_partkey) AS ord, CASE WHEN any_value(odd) AND min(n) = 1 THEN any_value(core) ELSE '' END AS aliases, CASE WHEN any_value(p_size) = 7 THEN '民办' END AS nature FROM k GROUP BY 1, 2"""
)
def entity_table(spark, sf_dir):
    """G22 of all parts as points, half of them campuses; attached names and corrections are tested case by case."""
    p = read(spark, sf_dir, "part").withColumn("name", F.when(F.col("p_size") % 2 == 1, F.concat("p_name", F.lit("（东校区）"))).otherwise(F.concat("p_name", F.when(F.col("p_size") == 8, "x").otherwise(""))))
    points = p.select(F.col("p_partkey").alias("ord"), "name", F.col("p_size").cast("string").alias("area"), F.col("p_type").alias("stage"), F.lit(None).cast("string").alias("id"))
    key = N.surrogate_key(F.col("area"), F.col("area"), N.strict_norm_spaces(F.col("name")))
    frame = lambda schema: spark.createDataFrame([], schema)
    out = entities.entity_table(
        points, points.filter("area = '8'"), frame("name string, fixed string"), frame("name string, area string, right string"), frame("ord int, stage string, name string, alias string, force boolean"), frame("id string, alias string"),
        points.filter("area = '7'").select(key.alias("id")), {},
    )
    return out.select("id", "stage", "ord", F.array_join("aliases", ",").alias("aliases"), "nature")


_CAMPUS_SITES = "SELECT p_partkey AS pk, CASE WHEN p_size % 4 <> 0 THEN 'gz-' || p_partkey END AS id, p_name || '-' || p_partkey AS name, p_brand AS school, p_size < 20 AS site, 'E' || p_partkey AS e FROM part"


def _campus_sites(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_size", F.concat(F.lit("gz-"), key).alias("gz"), F.concat("p_name", F.lit("-"), key).alias("name"), F.col("p_brand").alias("school"), F.concat(F.lit("E"), key).alias("e"))
    sites = p.filter("p_size < 20").select(F.when(F.col("p_size") % 4 != 0, F.col("gz")).alias("id"), "name", "school", "ord")
    return p, sites, p.select(F.col("gz").alias("id"), F.col("e").alias("name"))


@query(
    f"""WITH p AS ({_CAMPUS_SITES}), q AS (SELECT l_suppkey AS m, coalesce(id, name) AS key, coalesce(CASE WHEN id IS NOT NULL THEN e END, name) AS nm, school, CASE WHEN id IS NOT NULL THEN e END AS poi, pk, count(*) AS n FROM lineitem JOIN p ON l_partkey = pk WHERE l_returnflag = 'A' AND site GROUP BY ALL),
 b AS (SELECT l_suppkey AS m, site AND (pk % 3 = 0 OR id IS NOT NULL) AS listed, CASE WHEN pk % 3 <> 0 THEN 'gz-' || pk WHEN site THEN coalesce(id, name) ELSE name END AS key, CASE WHEN pk % 3 <> 0 THEN e ELSE name END AS nm, school, CASE WHEN pk % 3 <> 0 AND (NOT (site AND id IS NOT NULL) OR pk % 2 = 0) THEN e END AS poi, pk, min(l_extendedprice) AS score FROM lineitem JOIN p ON l_partkey = pk WHERE l_returnflag = 'R' GROUP BY ALL),
 r AS (SELECT coalesce(q.m, b.m) AS middle, 'batch' AS part, coalesce(q.key, b.key) AS key, coalesce(b.nm, q.nm) AS name, coalesce(b.school, q.school) AS school, coalesce(b.poi, q.poi) AS poi, n, score, coalesce(q.pk, 1099511627776) AS o1, b.pk AS o2 FROM q FULL JOIN (FROM b WHERE listed) b ON q.m = b.m AND q.key = b.key
 UNION ALL SELECT d.m, 'district', d.key, d.e, NULL, d.e, d.n, b.score, 0, d.pk FROM (SELECT l_suppkey AS m, pk, 'gz-' || pk AS key, e, count(*) AS n FROM lineitem JOIN p ON l_partkey = pk WHERE l_returnflag = 'N' GROUP BY ALL) d LEFT JOIN (FROM b WHERE NOT listed) b ON d.m = b.m AND d.key = b.key)
 SELECT middle, part, key, name, school, poi, n, score, row_number() OVER (PARTITION BY middle, part ORDER BY coalesce(n, 0) DESC, o1, o2) AS place FROM r"""
)
def linkage_middle(spark, sf_dir):
    """G16 of all suppliers as middle schools and parts as campuses, some without an entity, some asked for by name."""
    p, sites, e = _campus_sites(spark, sf_dir)
    l = read(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "ord")
    of = lambda flag, *keep: l.filter(F.col("l_returnflag") == flag).join(p, "ord").groupBy(F.col("l_suppkey").alias("middle"), "ord", *keep)
    quota = l.filter("l_returnflag = 'A'").join(sites, "ord").groupBy(F.col("l_suppkey").alias("middle"), F.coalesce("id", "name").alias("key")).agg(F.count("*").alias("n"))
    batch = of("R", F.when(F.col("ord") % 3 == 0, F.col("name")).otherwise(F.col("gz")).alias("key")).agg(F.min("l_extendedprice").alias("score"))
    district = of("N", F.col("gz").alias("key")).agg(F.count("*").alias("n"))
    places = e.filter(F.substring("name", -1, 1).isin("0", "2", "4", "6", "8")).select("name", F.col("name").alias("poi"))
    return linkage.middle_linkage(quota, batch, district, sites, e, places)


@query(
    f"""WITH p AS ({_CAMPUS_SITES}), t AS (SELECT school, min(pk) AS qid FROM p GROUP BY 1), c AS (SELECT school AS brand, l_suppkey, count(*) AS n, string_agg(DISTINCT s_nationkey::VARCHAR, ',') AS areas FROM lineitem JOIN p ON l_partkey = pk JOIN supplier ON s_suppkey = l_suppkey WHERE site AND id IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT qid, 'quota' AS part, l_suppkey, n, areas FROM c JOIN t ON brand = school UNION ALL SELECT qid, 'district', l_suppkey, count(*), '' FROM lineitem JOIN p ON l_partkey = pk JOIN t USING (school) WHERE l_returnflag = 'N' GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY qid, part ORDER BY n DESC, l_suppkey) AS place FROM r)
 SELECT qid, part, 'S' || l_suppkey AS school, CASE WHEN l_suppkey % 2 = 0 THEN 'gz-' || l_suppkey END AS school_id, n, areas, place FROM x WHERE place <= CASE part WHEN 'quota' THEN 30 ELSE 50 END"""
)
def linkage_high(spark, sf_dir):
    """G16 of all brands as high schools with their parts as campuses and suppliers as the schools that send pupils."""
    p, sites, e = _campus_sites(spark, sf_dir)
    targets = p.groupBy(F.col("school").alias("name")).agg(F.min("ord").alias("qid"))
    l = read(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "ord").join(p, "ord").withColumnRenamed("l_suppkey", "s_suppkey")
    l = joins.lookup(l, read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("area")), "s_suppkey").filter("area is not null")
    sender = [F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("school"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("gz-"), F.col("s_suppkey").cast("string"))).alias("school_id"), F.col("s_suppkey").alias("by")]
    coverage = l.groupBy(F.col("gz").alias("campus"), "area", *sender).agg(F.count("*").alias("n")).withColumnRenamed("by", "ord")
    near = l.filter("l_returnflag = 'N'").groupBy(F.col("school").alias("target"), "area", *sender).agg(F.count("*").alias("n")).withColumnRenamed("by", "ord")
    return linkage.high_linkage(targets, sites, e, coverage, near).withColumn("areas", F.array_join("areas", ","))


@query(
    """WITH f AS (SELECT c_custkey, string_agg(CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE 's' || s_suppkey END || '=s' || s_suppkey, ',' ORDER BY CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE 's' || s_suppkey END) AS scope FROM customer JOIN supplier ON (c_mktsegment = 'BUILDING' AND s_nationkey = c_nationkey) OR (c_mktsegment = 'MACHINERY' AND s_nationkey + 1 = c_nationkey) WHERE c_custkey % 2 = 0 GROUP BY 1)
 SELECT c_custkey AS row, CASE WHEN c_custkey % 2 = 0 THEN coalesce(scope, '') ELSE 'x=y' END AS scope FROM customer LEFT JOIN f USING (c_custkey)"""
)
def reverse_backfill(spark, sf_dir):
    area = lambda c: F.concat(F.lit("n"), c.cast("string"))
    given = F.when(F.col("c_custkey") % 2 == 1, F.create_map(F.lit("x"), F.array(F.lit("y"))))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), area(F.col("c_nationkey")).alias("id"), F.lit(None).cast("array<string>").alias("ids"), F.col("c_mktsegment").alias("mechanism"), given.alias("scope"))
    s = read(spark, sf_dir, "supplier").withColumn("id", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    feeds = s.select("id", F.create_map(F.lit("BUILDING"), F.array(area(F.col("s_nationkey"))), F.lit("MACHINERY"), F.array(area(F.col("s_nationkey") + 1))).alias("by_mechanism"))
    out = graph.reverse_backfill(rows, feeds, s.filter("s_suppkey % 3 > 0").select("id", F.col("s_name").alias("name")))
    pairs = F.transform(F.map_entries(F.coalesce("scope", F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("="), v)))
    return out.select("row", F.array_join(F.flatten(pairs), ",").alias("scope"))


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 2 AND c_custkey % 2 = 0 THEN '2026=' || c_mktsegment || '|特控线上线率 2026=' || c_nationkey
 ELSE '学部=' || CASE c_custkey % 3 WHEN 0 THEN '小学' WHEN 1 THEN '初中' ELSE '高中' END || '|所在区=' || coalesce(n_name, '—') || CASE c_custkey % 3 WHEN 0 THEN '|2026班数=' || c_nationkey || ' 个班|招生地段=' || c_mktsegment WHEN 1 THEN '|生源小学=' || CASE WHEN c_custkey % 2 = 0 THEN c_name || '、' || c_mktsegment ELSE '无公办对口名单（民办校以摇号/直升为准）' END ELSE '' END END AS card,
 '/school/' || replace(c_name, '#', '%23') || '?stage=' || CASE c_custkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'middle' ELSE 'high' END || '&id=gz-' || c_custkey AS address
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 12"""
)
def place_card(spark, sf_dir):
    n = read(spark, sf_dir, "nation").filter("n_nationkey < 12").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("area_name"))
    c = joins.lookup(read(spark, sf_dir, "customer"), n, "c_nationkey")
    key, text = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    stage = F.when(key % 3 == 0, "primary").when(key % 3 == 1, "middle").otherwise("high")
    ident = F.concat(F.lit("gz-"), key.cast("string"))
    points = c.select(
        key.alias("k"), F.col("c_name").alias("name"), ident.alias("school_id"), "area_name", F.array(stage).alias("stages"), stage.alias("main_stage"), F.create_map(stage, ident).alias("ids"), (key % 2 == 0).alias("has_record"),
        F.array(F.struct(F.lit("2026").alias("label"), F.col("c_mktsegment").alias("value"))).alias("scores"), text.alias("top_rate"), F.lit("").alias("high_share"), F.col("c_nationkey").alias("classes"), F.col("c_mktsegment").alias("zone"), F.lit(None).cast("string").alias("route"),
        F.when(key % 2 == 0, F.array("c_name", "c_mktsegment")).alias("feeders"),
    )
    out = linkage.place_card(points)
    return out.select("k", F.array_join(F.transform("rows", lambda r: F.concat(r["label"], F.lit("="), r["value"])), "|").alias("card"), F.col("links")[0]["to"].alias("address"))


def _d(a: str, b: str) -> str:
    return f"2 * 6371000 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))"


@query(
    f"""WITH c AS (SELECT c_custkey AS id, c_nationkey AS area, CASE WHEN c_custkey % 4 = 0 THEN c_custkey // 8 END AS ident, {PLACE.format('c_custkey')} FROM customer),
 f AS (SELECT ident, min(id) AS of_id FROM c WHERE ident IS NOT NULL GROUP BY 1), n AS (SELECT c.*, of_id FROM c LEFT JOIN f USING (ident)),
 g AS (SELECT lng, lat, arg_min(of_id, id) FILTER (WHERE of_id IS NOT NULL) AS named, min(id) AS anyone FROM n GROUP BY 1, 2),
 m AS (SELECT n.* FROM n JOIN g ON n.lng = g.lng AND n.lat = g.lat WHERE id = coalesce(of_id, named, anyone)),
 s AS (SELECT s_suppkey AS sid, s_nationkey AS area, {PLACE.format('s_suppkey')} FROM supplier),
 p AS (SELECT m.id, s.sid, {_d('m', 's')} AS d, row_number() OVER (PARTITION BY m.id ORDER BY {_d('m', 's')}, s.sid) AS r FROM m JOIN s ON m.area = s.area),
 k AS (SELECT m.id, string_agg(s.sid::VARCHAR, ',' ORDER BY s.sid) AS near FROM m JOIN s ON {_d('m', 's')} <= 5000 GROUP BY 1)
 SELECT m.id, p.sid AS plate_id, round(p.d, 2) AS plate_m, coalesce(near, '') AS sites FROM m LEFT JOIN p ON m.id = p.id AND p.r = 1 LEFT JOIN k ON m.id = k.id"""
)
def view_points(spark, sf_dir):
    c = placed(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area"), F.when(F.col("c_custkey") % 4 == 0, F.floor(F.col("c_custkey") / 8)).alias("ident")), "id")
    s = placed(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("area")), "s_suppkey")
    merged = joins.merge_points(c, "id", "ident", ["lng", "lat"], "id")
    out = indicators.point_view(merged, s.withColumnRenamed("s_suppkey", "plate_id"), s.withColumnRenamed("s_suppkey", "station_id"), "area", "id", 5000.0)
    return out.select("id", "plate_id", F.round("plate_m", 2).alias("plate_m"), F.array_join(F.transform("sites", lambda x: x.cast("string")), ",").alias("sites"))


@query("WITH b AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 4 END AS batch FROM orders), p AS (SELECT *, min(batch) OVER (PARTITION BY o_custkey) AS best FROM b), y AS (SELECT o_custkey, year(o_orderdate) AS y, max(o_totalprice) AS top, sum(o_totalprice::DECIMAL(18,2)) AS s, count(*) AS n FROM p WHERE batch = best GROUP BY 1, 2) SELECT o_custkey, y, top, round((sum(s) OVER w)::DOUBLE / (sum(n) OVER w)::DOUBLE, 2) AS mean FROM y WINDOW w AS (PARTITION BY o_custkey)")
def view_high_ranking(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 4).alias("batch"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"), F.col("o_orderpriority").alias("name"))
    out = indicators.high_ranking(o, "o_custkey", "name", "y", "batch", "v", [3, 4], 2)
    return out.select("o_custkey", "y", F.col("top").cast("double").alias("top"), "mean")


@query("WITH a AS (SELECT o_custkey AS k, o_orderkey AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_totalprice AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') SELECT a.k AS cust, a.n AS k, l AS ord, m FROM a LEFT JOIN b ON a.k = b.k AND a.n = b.n UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT k FROM a)")
def view_middle_ranking(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ord"), "o_orderstatus", F.col("o_totalprice").alias("m"))
    rows, metrics = o.filter("o_orderstatus = 'F'").select("cust", "ord"), o.filter("o_orderstatus = 'O'").select("cust", F.col("ord").alias("ord2"), "m")
    out = joins.positional(rows, metrics, "cust", ["ord"], ["ord2"])
    every = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"))
    return joins.append_missing(out, every, "cust").select("cust", "k", "ord", "m")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    """An extension without a counterpart: the batch form of the windowed stream in tessera.streaming."""
    return windows.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", "event_type", "value")


# --- readers and writers, over files that the query writes into the shared folder
def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderpriority AS kind, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1)::INT AS ord, o_orderkey FROM orders")
def json_documents(spark, sf_dir):
    """One document for each priority; ``ord`` is the place in the document, which the document's own order gives."""
    path = _folder(spark, "json")
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("kind"))))
    docs = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(rows.alias("records"))
    docs.select("o_orderpriority", F.to_json(F.struct("records")).alias("value")).write.partitionBy("o_orderpriority").text(path)
    return tables.read_json_records(spark, f"{path}/*", "o_orderkey long, kind string").select("kind", F.col("ord").cast("int"), "o_orderkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_sorted(spark, sf_dir):
    """Written in a fixed order and read back."""
    path = _folder(spark, "json-sorted")
    tables.write_json_sorted(read(spark, sf_dir, "nation"), path, ["n_nationkey"])
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query("SELECT n_nationkey, 'nation' AS tbl FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region")
def file_name_columns(spark, sf_dir):
    """S3: which file a row is from."""
    both = [read(spark, sf_dir, t).select(F.col(k).alias("n_nationkey"), F.input_file_name().alias("path")) for t, k in (("nation", "n_nationkey"), ("region", "r_regionkey"))]
    return tables.from_file_names(both[0].union(both[1]), "path", {"tbl": r"/(\w+)\.parquet"}).select("n_nationkey", "tbl")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_by_category(spark, sf_dir):
    """A folder for each segment, read back as one table."""
    path = _folder(spark, "csv")
    tables.write_csv(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path, by="c_mktsegment")
    return tables.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, nullif(split_part(p_name, ' ', 2), '') AS second, NULL::VARCHAR AS ninth FROM part")
def positional_cells(spark, sf_dir):
    """Columns by their place in a row of cells."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("cells"))
    first, second, *_, ninth = tables.positional("cells", ["first", "second", *map(str, range(6)), "ninth"])
    return p.select("p_partkey", first, second, ninth)


@query("SELECT p_partkey, 1 AS row_no, p_size || '|' || p_brand AS cells FROM part")
def second_tables(spark, sf_dir):
    """The second table's rows of two cells that don't repeat the header."""
    p = read(spark, sf_dir, "part")
    head = "<p><table><tr><th>no</th><th>name</th></tr></table><table><tr><td>no</td><td>name</td></tr><tr><td>"
    html = F.concat(F.lit(head), F.col("p_size").cast("string"), F.lit("</td><td> <b>"), "p_brand", F.lit("</b></td></tr><tr><td>1</td></tr></table>"))
    rows = tables.nth_table(p.withColumn("html", html), "p_partkey", "html", 1).filter(tables.wide_enough("cells", 2, "^no$"))
    return rows.select("p_partkey", "row_no", F.array_join("cells", "|").alias("cells"))


@query("SELECT n_nationkey, n_regionkey AS kept FROM nation")
def trimmed_columns(spark, sf_dir):
    """A column and a field of a struct less."""
    n = read(spark, sf_dir, "nation").withColumn("s", F.struct(F.col("n_regionkey").alias("kept"), F.col("n_name").alias("gone")))
    out = codec.trim(n, ["n_name", "n_regionkey"], {"s": ["gone"]})
    return out.select("n_nationkey", "s.*")


@query("SELECT count(*) AS n, 0 AS missing FROM nation")
def catalogue_rows(spark, sf_dir):
    """A listed table is there and can be read."""
    c = tables.Catalogue(spark, sf_dir, ["nation", "region"])
    return c.read("nation").agg(F.count("*").alias("n")).withColumn("missing", F.lit(len(c.missing())))


@query("SELECT p_partkey, p_name FROM part")
def projected_fields(spark, sf_dir):
    """allow-listed fields, of which the table has two."""
    return filters.project(read(spark, sf_dir, "part"), ["p_partkey", "nothing", "p_name"])


@query("SELECT o_custkey, coalesce(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 END), 0)::BIGINT AS total FROM orders GROUP BY 1")
def sums_over_maps(spark, sf_dir):
    """The sum of a map's values whose key is kept."""
    n = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    cells = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("cells"))
    return cells.select("o_custkey", aggregates.map_sum("cells", lambda k: k != "P").alias("total"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 <> 0 THEN floor(s_acctbal / 1000) END DESC NULLS LAST, s_name) AS rank FROM supplier")
def rank_by_score_and_name(spark, sf_dir):
    """O3: by score with nulls last, then by name in binary order."""
    score = F.when(F.col("s_suppkey") % 3 != 0, F.floor(F.col("s_acctbal") / 1000))
    return ranking.ranked(read(spark, sf_dir, "supplier"), [score.desc_nulls_last(), ranking.collated(F.col("s_name"))]).select("s_suppkey", "rank")


_RANKING = """WITH r AS (SELECT l_suppkey AS k, l_orderkey AS o, l_linenumber AS n, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS p FROM lineitem WHERE l_quantity > 45),
 m AS (SELECT l_suppkey AS k, l_extendedprice AS price, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS p FROM lineitem WHERE l_quantity < 5)"""


@query(_RANKING + " SELECT r.k, r.o, r.n, price FROM r LEFT JOIN m USING (k, p) UNION ALL SELECT s_suppkey, NULL, NULL, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM r)")
def view_middle_web(spark, sf_dir):
    """G21, one variant: entities without a row are appended."""
    return _middle(spark, sf_dir, True).select(F.col("supp").alias("k"), "o", "n", "price")


@query(_RANKING + " SELECT r.k, r.o, r.n, price FROM r LEFT JOIN m USING (k, p)")
def view_middle_mini(spark, sf_dir):
    """G21, the other variant: only entities with rows."""
    return _middle(spark, sf_dir, False).select(F.col("supp").alias("k"), "o", "n", "price")


def _middle(spark, sf_dir, keep_without):
    l = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"))
    rows, metrics = l.filter("q > 45").select("supp", "o", "n"), l.filter("q < 5").select("supp", F.col("o").alias("mo"), F.col("n").alias("mn"), "price")
    every = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"))
    return indicators.middle_ranking(rows, metrics, "supp", ["o", "n"], ["mo", "mn", "price"], keep_without, every)
