"""Filters, joins, resolution, aggregation, order, sets, graph and quality operators bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import campuses, feeds, filters, graph, joins, quality, ranking, resolve, sequence, sets
from tessera.plans import indicators
from tessera.queries.registry import query, read
from tessera.queries.text import PLACE, placed

MONEY = "decimal(18,2)"
_PARTS = "WITH e AS (SELECT p_partkey AS id, p_partkey AS ord, p_name AS name, p_brand AS area, p_type AS stage FROM part), q AS (SELECT DISTINCT p_name AS name, p_brand AS area FROM part) "


def _entities(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("area"), F.col("p_type").alias("stage"), F.col("p_size").alias("size"))


def _queries(spark, sf_dir):
    return _entities(spark, sf_dir).select("name", "area").distinct()


# --- indicators
_SCORE = "CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END"
_KIND = {"city": "l_partkey % 5 = 0", "other": "NOT (l_partkey % 5 = 0)", "top": "l_partkey % 10 = 0"}
_NOW = ", ".join(
    f"min(CASE WHEN {c} THEN s END) AS {k}_min, count(CASE WHEN {c} THEN 1 END) AS {k}_pairs, count(CASE WHEN ({c}) AND s IS NULL THEN 1 END) AS {k}_failed, round(count(CASE WHEN ({c}) AND s IS NULL THEN 1 END)::DOUBLE / nullif(count(CASE WHEN {c} THEN 1 END), 0), 4) AS {k}_failed_rate"
    for k, c in _KIND.items()
)
OUTCOME = f"""WITH l AS (SELECT *, {_SCORE} AS s, year(l_shipdate) AS y FROM lineitem),
 now AS (SELECT l_suppkey, {_NOW} FROM l WHERE y = 1996 GROUP BY 1),
 per AS (SELECT l_suppkey, y, {', '.join(f'min(CASE WHEN {c} THEN s END) AS {k}' for k, c in _KIND.items())} FROM l WHERE y IN (1994, 1995, 1996) GROUP BY 1, 2),
 mean AS (SELECT l_suppkey, {', '.join(f'round(avg({k}), 1) AS {k}_mean' for k in _KIND)} FROM per GROUP BY 1)
 SELECT * FROM mean FULL JOIN now USING (l_suppkey)"""


def _outcome(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_extendedprice", F.year("l_shipdate").alias("y"))
    score = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    return indicators.quota_outcome(rows, "l_suppkey", "y", score, F.col("l_partkey") % 5 == 0, F.col("l_partkey") % 10 == 0, 1996, [1994, 1995, 1996])


@query(OUTCOME)
def quota_outcome(spark, sf_dir):
    return _outcome(spark, sf_dir)


@query(
    f"""WITH o AS ({OUTCOME}) SELECT s_name, n_name, city_min, other_min, top_min, row_number() OVER (ORDER BY city_min IS NULL, city_min DESC, s_suppkey) AS rank
 FROM o JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
)
def outcome_ranked(spark, sf_dir):
    """The flagship: outcome indicators with their supplier and nation, ranked with nulls last."""
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    rows = joins.lookup(_outcome(spark, sf_dir).withColumnRenamed("l_suppkey", "s_suppkey"), supplier, "s_suppkey").filter(F.col("s_name").isNotNull())
    rows = joins.lookup(rows.withColumnRenamed("s_nationkey", "n_nationkey"), nation, "n_nationkey")
    return ranking.ranked(rows, [F.desc_nulls_last("city_min"), F.col("s_suppkey")]).select("s_name", "n_name", "city_min", "other_min", "top_min", "rank")


# --- aggregates
@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def count_by_area(spark, sf_dir):
    return A.count_by(read(spark, sf_dir, "customer"), "c_nationkey")


@query("WITH m AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3), c AS (SELECT coalesce(n_name, '其他') AS n_name, count(*) AS n FROM customer LEFT JOIN m ON c_nationkey = n_nationkey GROUP BY 1) SELECT *, (sum(n) OVER ())::BIGINT AS total FROM c")
def summary_by_mapped_name(spark, sf_dir):
    m = read(spark, sf_dir, "nation").filter("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    return A.count_by_mapped(read(spark, sf_dir, "customer"), "c_nationkey", m, "n_name")


@query("SELECT l_suppkey, l_returnflag, min(try_cast(nullif(v, '') AS INTEGER)) AS min_value, bool_or(v <> '') AS admitted, count(*) AS rows FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN '' ELSE (l_partkey % 900)::VARCHAR END AS v FROM lineitem) GROUP BY 1, 2")
def pair_minimum(spark, sf_dir):
    v = F.when(F.col("l_linenumber") == 1, "").otherwise((F.col("l_partkey") % 900).cast("string"))
    return A.pair_minimum(read(spark, sf_dir, "lineitem").withColumn("v", v), "l_suppkey", "l_returnflag", "v")


@query("SELECT l_suppkey, round(sum(CASE WHEN r IS NOT NULL THEN l_quantity::DECIMAL(18,4) * r::DECIMAL(18,4) END)::DOUBLE / sum(CASE WHEN r IS NOT NULL THEN l_quantity::DECIMAL(18,4) END)::DOUBLE, 4) AS expected_rate, count(r) AS rated FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_discount END AS r FROM lineitem) GROUP BY 1")
def weighted_rate(spark, sf_dir):
    return A.weighted_rate(read(spark, sf_dir, "lineitem").withColumn("r", F.when(F.col("l_returnflag") != "R", F.col("l_discount"))), "l_suppkey", "l_quantity", "r")


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderpriority)), ',') AS items, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount FROM orders GROUP BY 1")
def merge_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.array("o_orderpriority").alias("items"), F.col("o_totalprice").cast(MONEY).alias("amount"))
    return A.merge_rows(o, "o_custkey", "items", "amount").select("o_custkey", F.array_join("items", ",").alias("items"), F.col("amount").cast("double").alias("amount"))


_MEDAL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'gold' WHEN '2' THEN 'silver' WHEN '3' THEN 'bronze' END"
_PIVOT = f"SELECT o_custkey, y, count(CASE WHEN m = 'gold' THEN 1 END) AS gold, count(CASE WHEN m = 'silver' THEN 1 END) AS silver, count(CASE WHEN m = 'bronze' THEN 1 END) AS bronze FROM (SELECT o_custkey, year(o_orderdate) AS y, {_MEDAL} AS m FROM orders) GROUP BY 1, 2"


def _pivot(spark, sf_dir):
    from tessera.functions.names import medal

    o = read(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), medal(F.col("o_orderpriority"), {"gold": ["^1"], "silver": ["^2"], "bronze": ["^3"]}).alias("m"))
    return A.medal_pivot(o, ["o_custkey", "y"], "m", ["gold", "silver", "bronze"])


@query(_PIVOT)
def medal_pivot(spark, sf_dir):
    return _pivot(spark, sf_dir)


@query(f"WITH p AS ({_PIVOT}), t AS (SELECT max(y) AS t FROM p) SELECT o_custkey, " + ", ".join(f"sum(CASE WHEN y = t THEN {m} ELSE 0 END)::BIGINT AS {m}_latest" for m in ("gold", "silver", "bronze")) + ", " + ", ".join(f"sum({m})::BIGINT AS {m}_all" for m in ("gold", "silver", "bronze")) + " FROM p, t GROUP BY 1")
def medals_latest_and_all(spark, sf_dir):
    return A.latest_and_all(_pivot(spark, sf_dir), "o_custkey", "y", ["gold", "silver", "bronze"])


@query(f"WITH p AS ({_PIVOT}), l AS (SELECT * FROM p WHERE y = (SELECT max(y) FROM p)) SELECT o_custkey, row_number() OVER (ORDER BY gold DESC, silver DESC, bronze DESC, gold + silver + bronze DESC, o_custkey) AS rank FROM l")
def medal_rank_latest(spark, sf_dir):
    p = _pivot(spark, sf_dir)
    latest = p.join(F.broadcast(p.agg(F.max("y").alias("y"))), "y", "left_semi")  # one row
    return ranking.ranked(latest, ranking.medal_order("gold", "silver", "bronze", "o_custkey")).select("o_custkey", "rank")


@query("WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, max(o_totalprice) AS top, sum(o_totalprice::DECIMAL(18,2)) AS s, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, y, top, round((sum(s) OVER (PARTITION BY o_custkey))::DOUBLE / (sum(n) OVER (PARTITION BY o_custkey))::DOUBLE, 2) AS mean FROM o")
def pooled_mean(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast(MONEY).alias("v"))
    out = A.pooled(o, "o_custkey", "y", "v", 2)
    return out.select("o_custkey", "y", F.col("top").cast("double").alias("top"), "mean")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, min(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 4 END) OVER (PARTITION BY o_custkey) AS b, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 4 END AS c FROM orders) WHERE b = c")
def preferred_batch(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("batch", F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 4))
    return A.preferred(o, "o_custkey", "batch", [3, 4]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("WITH g AS (SELECT l_orderkey AS k, sum((l_extendedprice * (1 - l_discount) * (1 + l_tax))::DECIMAL(18,2)) AS total FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS k, o_totalprice::DECIMAL(18,2) AS total FROM orders) SELECT coalesce(g.k, d.k) AS k, g.total::DOUBLE AS total, (coalesce(g.total, 0) - coalesce(d.total, 0))::DOUBLE AS total_off FROM g FULL JOIN d ON g.k = d.k")
def control_totals(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey"))
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).cast(MONEY)
    declared = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast(MONEY).alias("total"))
    return A.control_totals(l, "k", {"total": price}, declared).select("k", F.col("total").cast("double").alias("total"), F.col("total_off").cast("double").alias("total_off"))


@query("SELECT l_orderkey, l_linenumber, t AS total, parts FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 7)::BIGINT AS t, ((l_partkey % 3) + (l_suppkey % 4))::BIGINT AS parts FROM lineitem) WHERE t <> parts")
def total_mismatch(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), (F.col("l_partkey") % 7).alias("total"), (F.col("l_partkey") % 3).alias("a"), (F.col("l_suppkey") % 4).alias("b"))
    out = A.total_mismatch(l, "k", "total", ["a", "b"])
    return out.select(F.split("k", "-")[0].cast("long").alias("l_orderkey"), F.split("k", "-")[1].cast("int").alias("l_linenumber"), "total", "parts")


@query("SELECT o_custkey, o_orderstatus AS k, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS v FROM orders GROUP BY 1, 2")
def union_maps(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.create_map("o_orderstatus", F.array("o_orderpriority")).alias("m"))
    return A.union_maps(o, "o_custkey", "m").select("o_custkey", F.explode("m").alias("k", "v")).select("o_custkey", "k", F.array_join("v", ",").alias("v"))


@query("WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS first, count(*) AS uses FROM part GROUP BY 1, 2) SELECT p_brand, p_type, uses, row_number() OVER (ORDER BY first, p_brand, p_type) - 1 AS dim_id FROM f")
def dimension_extract(spark, sf_dir):
    return A.dimension(read(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey")


@query("SELECT o_custkey, md5(array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',')) AS content_key FROM orders GROUP BY 1")
def content_groups(spark, sf_dir):
    g = A.value_set(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    return A.content_groups(g, ["values"], "o_custkey").select("o_custkey", "content_key")


@query("SELECT p_name, min(p_brand) AS p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def unique_keys(spark, sf_dir):
    return A.unique_keys(read(spark, sf_dir, "part"), "p_name", "p_brand")


@query("WITH b AS (SELECT p_brand, p_name, count(DISTINCT p_partkey) AS members, min(p_partkey) AS first_id, bool_or(p_size = 7) AS taken FROM part GROUP BY 1, 2) SELECT p_brand, p_name, members, first_id FROM b WHERE members >= 2 AND NOT taken")
def families(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return A.families(p, ["p_brand", "p_name"], "p_partkey", p.filter("p_size = 7"))


@query("WITH plans AS (SELECT l_suppkey AS school, l_returnflag AS campus, sum(l_quantity::DECIMAL(18,2)) AS q FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2), w AS (SELECT school, sum(q) AS q FROM plans GROUP BY 1), pt AS (SELECT DISTINCT l_suppkey AS school, l_linestatus AS campus FROM lineitem WHERE l_suppkey % 2 = 0 OR l_linestatus = 'O'), n AS (SELECT school, count(DISTINCT campus) AS n FROM pt GROUP BY 1) SELECT pt.school, pt.campus, (coalesce(plans.q, CASE WHEN n = 1 THEN w.q END))::DOUBLE AS plan FROM pt LEFT JOIN plans USING (school, campus) LEFT JOIN w USING (school) LEFT JOIN n USING (school)")
def allocate(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    plans = l.filter("l_linenumber < 3").select(F.col("l_suppkey").alias("school"), F.col("l_returnflag").alias("campus"), F.col("l_quantity").cast(MONEY).alias("q"))
    points = l.filter("l_suppkey % 2 = 0 or l_linestatus = 'O'").select(F.col("l_suppkey").alias("school"), F.col("l_linestatus").alias("campus")).distinct()
    return A.allocate(plans, points, "school", "campus", "q").withColumn("plan", F.col("plan").cast("double"))


@query("SELECT c_nationkey, min(c_mktsegment) AS c_mktsegment FROM customer GROUP BY 1")
def least_level(spark, sf_dir):
    return A.least_level(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS vals FROM customer GROUP BY 1")
def value_sets(spark, sf_dir):
    return A.value_set(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment").select("c_nationkey", F.array_join("values", ",").alias("vals"))


@query("SELECT CASE p_type WHEN (SELECT max(p_type) FROM part) THEN (SELECT min(p_type) FROM part) ELSE p_type END AS p_type, sum(p_size)::BIGINT AS p_size FROM part GROUP BY 1")
def folded_sum(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    variants = p.agg(F.max("p_type").alias("p_type"), F.min("p_type").alias("canonical"))
    return A.folded_sum(p, "p_type", variants, "p_size")


@query("SELECT count(*) AS rows, (sum(('0x' || substr(md5(n_nationkey::VARCHAR || '|' || n_name), 1, 12))::BIGINT::HUGEINT))::VARCHAR AS digest FROM nation")
def table_digest(spark, sf_dir):
    return A.digest(read(spark, sf_dir, "nation"), ["n_nationkey", "n_name"])


@query(f"WITH c AS (SELECT c_custkey, c_nationkey, {PLACE.format('c_custkey')} FROM customer), m AS (SELECT *, avg(lng) OVER w AS mx, avg(lat) OVER w AS my, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY c_nationkey)), d AS (SELECT *, round(pow(lng - mx, 2) + pow(lat - my, 2), 9) AS d FROM m), r AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY d) AS r FROM d) SELECT c_custkey, c_nationkey FROM r WHERE r <= greatest(ceil(n * 0.85), 3)")
def focus_core(spark, sf_dir):
    c = placed(read(spark, sf_dir, "customer"), "c_custkey")
    return A.trimmed_core(c, "c_nationkey", "lng", "lat").select("c_custkey", "c_nationkey")


@query("SELECT count(*) AS total, count_if(o_totalprice > 100000) AS matched, count_if(NOT (o_totalprice > 100000)) AS unmatched FROM orders")
def summary_counters(spark, sf_dir):
    return A.summary(read(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000)


@query("SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 2 WHEN 'F' THEN 1 ELSE -1 END) WHEN 3 THEN 'P' WHEN 2 THEN 'O' WHEN 1 THEN 'F' END AS o_orderstatus, count(DISTINCT o_orderpriority) AS members FROM orders GROUP BY 1")
def strictest(spark, sf_dir):
    out = A.strictest(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", {"P": 3, "O": 2, "F": 1}, "o_orderpriority")
    return out.withColumn("members", F.col("members").cast("long"))


@query(f"WITH c AS (SELECT {PLACE.format('c_custkey')} FROM customer) SELECT round((min(lng) + max(lng)) / 2, 6) AS lng, round((min(lat) + max(lat)) / 2, 6) AS lat, round(greatest(max(lng) - min(lng), 0.012) * 0.7, 6) AS span_lng, round(greatest(max(lat) - min(lat), 0.012) * 0.7, 6) AS span_lat FROM c")
def focus_box(spark, sf_dir):
    return A.focus_box(placed(read(spark, sf_dir, "customer"), "c_custkey"), "lng", "lat")


@query(f"SELECT c_nationkey, min(lng) AS w, min(lat) AS s, max(lng) AS e, max(lat) AS n FROM (SELECT c_nationkey, {PLACE.format('c_custkey')} FROM customer) GROUP BY 1")
def polygon_box(spark, sf_dir):
    c = placed(read(spark, sf_dir, "customer"), "c_custkey").select("c_nationkey", F.array(F.array("lng", "lat")).alias("ring"))
    rings = c.groupBy("c_nationkey").agg(F.collect_list("ring").alias("rings"))
    return A.polygon_box(rings, "c_nationkey", "rings")


@query("SELECT l_suppkey, year(l_shipdate) AS y, sum(l_quantity)::BIGINT AS q FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2")
def add_stages(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), "l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return A.add_stages(l, "l_suppkey", "y", "l_returnflag", ["A", "R"], ["q"])


@query("SELECT o_custkey, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN min(year(o_orderdate))::VARCHAR ELSE min(year(o_orderdate))::VARCHAR || '-' || max(year(o_orderdate))::VARCHAR END AS years FROM orders GROUP BY 1")
def year_ranges(spark, sf_dir):
    return A.year_range(read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), "o_custkey", "y")


# --- filters
@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) AND contains(c_name, '1')")
def area_keyword_filter(spark, sf_dir):
    return filters.by_area_and_keyword(read(spark, sf_dir, "customer"), "c_nationkey", "c_name", [1, 2, 3], " 1 ").select("c_custkey")


@query("SELECT p_partkey, (p_type = (SELECT min(p_type) FROM part) AND p_size % 3 = 0) AS shown FROM part")
def visible_points(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    kind = p.agg(F.min("p_type")).first()[0]
    p = p.withColumn("parts", F.array(F.struct(F.col("p_type").alias("stage"), F.lit("k").alias("class"), F.lit("n").alias("nature")))).withColumn("plate", F.col("p_size") % 3).withColumn("station", F.lit(None).cast("int")).withColumn("area", F.lit("x"))
    chosen = filters.Selection(frozenset([kind]), frozenset(["k"]), frozenset(["n"]), frozenset()).toggled("plates", 0)
    return p.select("p_partkey", filters.visible(chosen).alias("shown"))


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS kinds, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS stage, NOT (o_orderpriority LIKE '5%' OR o_orderpriority = '1-URGENT') AS listed FROM orders")
def predicates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    kinds = filters.any_of(F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P")
    stage = filters.in_stage(F.col("o_orderpriority"), "1-URGENT", {"1-URGENT": ["2-HIGH", "3-MEDIUM"]})
    return o.select("o_orderkey", kinds.alias("kinds"), stage.alias("stage"), filters.not_listed(F.col("o_orderpriority"), ["1-URGENT"], ["5"]).alias("listed"))


@query("WITH c AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS s FROM orders GROUP BY 1) SELECT o_custkey, list_contains(s, 'P') AS has_p, NOT list_contains(s, 'P') AND NOT list_contains(s, 'O') AS other, CASE WHEN list_contains(s, 'O') OR list_contains(s, 'F') THEN array_to_string(list_filter(['O', 'F'], lambda x: list_contains(s, x)), '、') ELSE '-' END AS shown FROM c")
def honour_filter(spark, sf_dir):
    s = A.value_set(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")
    v = F.col("values")
    return s.select("o_custkey", filters.has_any(v, ["P"], ["P", "O"]).alias("has_p"), filters.has_any(v, ["other"], ["P", "O"]).alias("other"), filters.honours(v, ["O", "F"]).alias("shown"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def mechanism_semi_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("many", F.array(F.col("o_custkey").cast("string"))).withColumn("one", F.col("o_custkey").cast("string"))
    c = read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    return filters.semi_by_ids(c, "k", o, "one", "many", F.col("o_orderstatus") == "P").select("c_custkey")


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END], lambda x: x IS NOT NULL), ',') AS badges FROM part")
def badge_lists(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(filters.badges([(F.col("p_size") > 40, "large"), (F.col("p_retailprice") > 1000, "dear")]), ",").alias("badges"))


@query("SELECT p_partkey FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size < 5) AND p_name IN (SELECT p_name FROM part WHERE p_size > 45)")
def in_both(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return filters.in_both(p, "p_name", p.filter("p_size < 5"), p.filter("p_size > 45")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE contains(c_name, '00') ORDER BY c_custkey LIMIT 12")
def search_names(spark, sf_dir):
    aliases = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("alias"), F.col("s_name").alias("entity_name"))
    return filters.search(read(spark, sf_dir, "customer"), "00", "c_name", "c_custkey", aliases).select("c_custkey")


# --- joins
@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def hash_lookup(spark, sf_dir):
    return joins.lookup(read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), read(spark, sf_dir, "nation"), "n_nationkey").select("s_suppkey", "n_name")


@query("WITH f AS (SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS k FROM orders GROUP BY 1) SELECT c_custkey, k AS first_order FROM customer LEFT JOIN f ON c_custkey = o_custkey")
def first_match(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"))
    return joins.first_match(read(spark, sf_dir, "customer"), o, "c_custkey", ["first_order"]).select("c_custkey", "first_order")


@query("WITH b AS (SELECT o_custkey AS k, o_orderkey AS v, 0 AS src FROM orders UNION ALL SELECT c_custkey, -c_custkey, 1 FROM customer WHERE c_custkey % 4 = 0) SELECT k, arg_max(v, (src, v)) AS v FROM b GROUP BY 1")
def last_write(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    b = read(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("k"), (-F.col("c_custkey")).alias("v"))
    return joins.last_write(a, b, "k", "v")


@query("SELECT DISTINCT p_partkey, unnest([p_size, p_size % 5]) AS id FROM part")
def index_ids(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.array("p_size", F.col("p_size") % 5).alias("many"))
    return joins.index_ids(p, "p_size", "many").select("p_partkey", "id")


@query("SELECT o_custkey, o_orderstatus AS k, min_by(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1, 2")
def keep_first_maps(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.create_map("o_orderstatus", "o_orderpriority").alias("m"))
    return joins.keep_first_maps(o, "o_custkey", "o_orderkey", "m").select("o_custkey", F.explode("m").alias("k", "v"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (3, 5)")
def reverse_lookup(spark, sf_dir):
    return joins.reverse_lookup(read(spark, sf_dir, "lineitem"), "l_suppkey", [3, 5]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("WITH v AS (SELECT l_suppkey, l_partkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS n, sum(l_quantity::BIGINT)::BIGINT AS n2 FROM lineitem GROUP BY 1, 2), c AS (SELECT *, CASE WHEN n <> 0 THEN n ELSE n2 END AS cover FROM v) SELECT l_suppkey, l_partkey, cover, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY cover DESC, l_partkey) AS rank FROM c) WHERE rank <= 3")
def coverage_topk(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    v = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", q).otherwise(0)).alias("n"), F.sum(q).alias("n2"))
    c = v.withColumn("cover", joins.first_nonzero("n", "n2"))
    return joins.coverage(c, "l_suppkey", F.col("cover"), ["l_partkey"], 3).select("l_suppkey", "l_partkey", "cover", "rank")


@query("WITH a AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_suppkey, l_partkey, min(l_extendedprice) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT * FROM a FULL JOIN b USING (l_suppkey, l_partkey)")
def full_outer_merge(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    a = l.filter("l_returnflag = 'A'").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    b = l.filter("l_returnflag = 'R'").groupBy("l_suppkey", "l_partkey").agg(F.min("l_extendedprice").alias("score"))
    return joins.merge_outer(a, b, ["l_suppkey", "l_partkey"], "n")


@query("SELECT c_custkey, m AS min_price FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_district_rows(spark, sf_dir):
    m = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_totalprice").alias("min_price"))
    return joins.lookup(read(spark, sf_dir, "customer"), m, "c_custkey").select("c_custkey", "min_price")


@query("SELECT p_name, sum(p_size)::BIGINT AS total, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS areas, min_by(p_partkey, p_partkey) AS first_id FROM part GROUP BY 1 ORDER BY total DESC, p_name LIMIT 30")
def coverage_merge(spark, sf_dir):
    out = joins.coverage_merge(read(spark, sf_dir, "part"), "p_name", "p_size", "p_brand", "p_partkey", "p_partkey", 30)
    return out.withColumn("areas", F.array_join("areas", ","))


@query("WITH a AS (SELECT o_custkey AS k, o_orderkey AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_orderkey AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') SELECT a.k AS cust, a.n AS k, l, r FROM a LEFT JOIN b ON a.k = b.k AND a.n = b.n")
def positional_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("l"))
    b = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("r"))
    return joins.positional(a, b, "cust", ["l"], ["r"])


@query("WITH r AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT id, n FROM r UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT id FROM r)")
def anti_append(spark, sf_dir):
    r = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return joins.append_missing(r, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unmatched_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unmatched(read(spark, sf_dir, "customer"), o, "c_custkey").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R') DESC, l_orderkey, l_linenumber) = 1 AS granted FROM lineitem")
def claim_once(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("explicit", F.col("l_returnflag") == "R").withColumn("ord", F.struct("l_orderkey", "l_linenumber"))
    return joins.claim_once(l, "l_partkey", "explicit", "ord").select("l_orderkey", "l_linenumber", "granted")


def _dist(a: str, b: str) -> str:
    return f"2 * 6371000 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))"


_SITES = f"WITH c AS (SELECT c_custkey AS id, c_nationkey AS area, {PLACE.format('c_custkey')} FROM customer), s AS (SELECT s_suppkey AS sid, s_nationkey AS area, {PLACE.format('s_suppkey')} FROM supplier) "


def _places(spark, sf_dir):
    c = placed(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area"), "c_name"), "id")
    return c, placed(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_nationkey").alias("area")), "sid")


@query(_SITES + f"SELECT id, sid, round(d, 3) AS metres FROM (SELECT c.id, s.sid, {_dist('c', 's')} AS d, row_number() OVER (PARTITION BY c.id ORDER BY {_dist('c', 's')}, s.sid) AS r FROM c JOIN s ON c.area = s.area) WHERE r = 1")
def nearest_site(spark, sf_dir):
    c, s = _places(spark, sf_dir)
    return joins.nearest(c, s, "area", "id", "sid", "sid").withColumn("metres", F.round("metres", 3))


@query(_SITES + f", p AS (SELECT c.id, s.sid FROM c, s WHERE {_dist('c', 's')} <= 4000) SELECT c.id, coalesce(array_to_string(list_sort(list(sid) FILTER (WHERE sid IS NOT NULL)), ','), '') AS sites FROM c LEFT JOIN p ON c.id = p.id GROUP BY 1")
def radius_sites(spark, sf_dir):
    c, s = _places(spark, sf_dir)
    return joins.radius_ids(c, s, 4000.0, "id", "sid").select("id", F.array_join(F.transform("sites", lambda x: x.cast("string")), ",").alias("sites"))


@query(_SITES + f"SELECT a.area, a.id AS i, b.id AS j, round({_dist('a', 'b')}, 3) AS metres FROM c a JOIN c b ON a.area = b.area AND a.id < b.id WHERE {_dist('a', 'b')} <= 3000 AND NOT (a.id % 7 = 0 AND b.id % 2 = 0)")
def proximity_pairs(spark, sf_dir):
    c, _ = _places(spark, sf_dir)
    out = joins.proximity_pairs(c, 3000.0, ["area"], "id")
    return out.filter(~((F.col("i") % 7 == 0) & (F.col("j") % 2 == 0))).withColumn("metres", F.round("metres", 3))


@query("WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_name END AS ident, p_brand AS x, p_size AS y FROM part), f AS (SELECT ident, min(id) AS of_id FROM p WHERE ident IS NOT NULL GROUP BY 1), n AS (SELECT p.*, of_id FROM p LEFT JOIN f USING (ident)), g AS (SELECT x, y, arg_min(of_id, id) FILTER (WHERE of_id IS NOT NULL) AS named, min(id) AS anyone FROM n GROUP BY 1, 2) SELECT id, coalesce(of_id, named, anyone) AS merged FROM n JOIN g USING (x, y)")
def point_merge(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("ident"), F.col("p_brand").alias("x"), F.col("p_size").alias("y"))
    return joins.merge_points(p, "id", "ident", ["x", "y"], "id").select("id", "merged")


@query("WITH g AS (SELECT event_id, user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 5 THEN 1 ELSE 0 END AS new FROM (SELECT min(event_id) AS event_id, user_id, value FROM events GROUP BY user_id, value)) SELECT event_id, (sum(new) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster FROM g")
def gap_clusters(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id", "value").agg(F.min("event_id").alias("event_id"))
    return joins.gap_groups(e, ["user_id"], "value", 5.0).select("event_id", "cluster")


@query("SELECT c_custkey, s_suppkey, round(gap, 4) AS gap FROM (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS gap, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE r = 1")
def nearest_value(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "area")
    s = read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "area")
    return joins.nearest_value(c, s, "area", "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal").withColumn("gap", F.round("gap", 4))


@query("SELECT p_partkey, CASE WHEN p_size % 4 <> 0 AND row_number() OVER (PARTITION BY p_brand, CASE WHEN p_size % 4 <> 0 THEN p_size END ORDER BY p_partkey) = 1 THEN p_size::VARCHAR ELSE p_name END AS key FROM part")
def conflict_spill(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("ident", F.when(F.col("p_size") % 4 != 0, F.col("p_size")))
    return joins.spill_conflicts(p, "p_brand", "ident", "p_name", "p_partkey").select("p_partkey", "key")


@query("WITH h AS (SELECT p_name, max((p_type = (SELECT min(p_type) FROM part))::INT) AS own FROM part WHERE p_size > 25 GROUP BY 1), o AS (SELECT DISTINCT p_name FROM part) SELECT p_name, CASE WHEN own = 1 THEN 'MATCHED' WHEN own = 0 THEN 'CROSS' ELSE 'MISSING' END AS status FROM o LEFT JOIN h USING (p_name)")
def roster_reconcile(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    first = p.crossJoin(F.broadcast(p.agg(F.min("p_type").alias("first"))))  # one row
    held = first.filter("p_size > 25").withColumn("stage", F.col("p_type") == F.col("first"))
    return joins.reconcile(p, held, "p_name", "stage", True)


@query("WITH a AS (SELECT DISTINCT p_name AS k FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_name AS k FROM part WHERE p_size > 40) SELECT k, 'official_only' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'held_only' FROM b WHERE k NOT IN (SELECT k FROM a)")
def two_way_gap(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("k", F.col("p_name"))
    return joins.two_way_gap(p.filter("p_size < 10"), p.filter("p_size > 40"), "k")


@query("WITH m AS (SELECT p_brand, p_name, arg_min(t, t) AS match FROM (SELECT a.p_brand, a.p_name, split_part(b.p_name, ' ', 1) AS t FROM (SELECT DISTINCT p_brand, p_name FROM part) a JOIN part b ON a.p_brand = b.p_brand AND contains(a.p_name, split_part(b.p_name, ' ', 1)) AND b.p_size < 10) GROUP BY 1, 2) SELECT p_partkey, match FROM part LEFT JOIN m USING (p_brand, p_name)")
def contained_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    right = p.filter("p_size < 10").select("p_brand", F.split("p_name", " ")[0].alias("t"))
    return joins.contained_either_way(p, right, "p_brand", "p_name", "t", "t").select("p_partkey", "match")


@query()
def corpus_hits(spark, sf_dir):
    """All distinct part and customer names and words of part names against all texts; no SQL, which would compare each with each."""
    p, c = read(spark, sf_dir, "part"), read(spark, sf_dir, "customer")
    names = p.select(F.col("p_name").alias("name")).union(c.select("c_name")).union(p.select(F.explode(F.split("p_name", " "))))
    return joins.corpus_hits(names.distinct(), "name", read(spark, sf_dir, "documents"), "text")


@query("WITH d AS (SELECT o_orderkey AS ord, [o_custkey] AS ids, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'P'), i AS (SELECT unnest(ids) AS k, min(ord) AS a FROM d GROUP BY 1), n AS (SELECT name, min(ord) AS b FROM d GROUP BY 1) SELECT c_custkey AS k, coalesce(a, b) AS document FROM customer LEFT JOIN i ON c_custkey = k LEFT JOIN n ON name = '1-URGENT'")
def document_lookup(spark, sf_dir):
    d = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("ord"), F.array("o_custkey").alias("ids"), F.col("o_orderpriority").alias("dname"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("1-URGENT").alias("name"))
    return joins.document_lookup(d, "ids", "dname", c, "k", "name", "ord").select("k", "document")


@query("WITH l AS (SELECT o_orderkey AS ord, o_custkey, o_custkey + 1 AS next, o_orderpriority AS k, o_totalprice AS v FROM orders), i AS (SELECT o_custkey AS id, ord, k, v FROM l UNION ALL SELECT next, ord, k, v FROM l), f AS (SELECT id, k, arg_min(v, ord) AS v FROM i GROUP BY 1, 2) SELECT c_custkey AS id, k, v FROM customer JOIN f ON id = c_custkey")
def member_maps(spark, sf_dir):
    """Each order lists two customers; a customer's first total of each priority."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("one"), F.array("o_custkey", F.col("o_custkey") + 1).alias("many"), F.col("o_orderkey").alias("ord"), F.create_map("o_orderpriority", "o_totalprice").alias("cells"))
    schools = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return joins.member_maps(schools, "id", rows, "one", "many", "ord", "cells").select("id", F.explode("cells").alias("k", "v"))


# --- resolution
@query(_PARTS + ", a AS (SELECT name, area, min(ord) AS o, arg_min(id, ord) AS id FROM e GROUP BY 1, 2), b AS (SELECT name, arg_min(id, ord) AS id FROM e GROUP BY 1) SELECT q.name, q.area, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN 0 WHEN b.id IS NOT NULL THEN 1 END AS tier FROM q LEFT JOIN a USING (name, area) LEFT JOIN b USING (name)")
def resolve_two_tier(spark, sf_dir):
    e, q = _entities(spark, sf_dir), _queries(spark, sf_dir).withColumn("qid", F.concat_ws("|", "name", "area"))
    return resolve.tiered(q, "qid", [(e, ["name", "area"]), (e, "name")], "id", "ord").select("name", "area", "id", "tier")


@query(_PARTS + ", a AS (SELECT name, area, min(id) AS id, count(DISTINCT id) AS n FROM e GROUP BY 1, 2), b AS (SELECT name, min(id) AS id, count(DISTINCT id) AS n FROM e GROUP BY 1) SELECT q.name, q.area, CASE WHEN a.n = 1 THEN a.id WHEN b.n = 1 THEN b.id END AS id, CASE WHEN a.n = 1 THEN 0 WHEN b.n = 1 THEN 1 END AS tier FROM q LEFT JOIN a USING (name, area) LEFT JOIN b USING (name)")
def resolve_cascade(spark, sf_dir):
    e, q = _entities(spark, sf_dir), _queries(spark, sf_dir).withColumn("qid", F.concat_ws("|", "name", "area"))
    return resolve.unique_tiers(q, "qid", [(e, ["name", "area"], False), (e, "name", False)], "id").select("name", "area", "id", "tier")


@query()
def resolve_all_tiers(spark, sf_dir):
    """J27 of all part names, some of them written otherwise, among the parts as entities; the tiers are tested case by case."""
    p = read(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("学校")).alias("name"), F.array("p_name").alias("aliases"), F.lit("middle").alias("stage"), F.col("p_brand").alias("area"))
    shape = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("广州市"), "p_name", F.lit("学校"))).when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("中学")))
    q = p.select(F.col("p_partkey").alias("qid"), shape.alias("name"), F.col("p_brand").alias("area"), F.lit(None).cast("string").alias("stage"))
    return resolve.cascade(q, e, e.limit(0), {"白云": "Brand#11"}).select("qid", "id", "how")


@query(_PARTS + ", c AS (SELECT q.name, q.area, e.id, e.area = q.area AS a, e.stage = (SELECT min(stage) FROM e) AS s, e.id % 2 = 0 AS m FROM q JOIN e USING (name)), n AS (SELECT *, count(*) OVER w AS n0, min(id) OVER w AS e0, count_if(a) OVER w AS n1, min(CASE WHEN a THEN id END) OVER w AS e1, CASE WHEN count_if(a) OVER w > 0 THEN a ELSE TRUE END AS k1 FROM c WINDOW w AS (PARTITION BY name, area)), n2 AS (SELECT *, count_if(k1 AND s) OVER w AS n2, min(CASE WHEN k1 AND s THEN id END) OVER w AS e2, CASE WHEN count_if(k1 AND s) OVER w > 0 THEN k1 AND s ELSE k1 END AS k2 FROM n WINDOW w AS (PARTITION BY name, area)), n3 AS (SELECT *, count_if(k2 AND m) OVER w AS n3, min(CASE WHEN k2 AND m THEN id END) OVER w AS e3 FROM n2 WINDOW w AS (PARTITION BY name, area)) SELECT name, area, min(CASE WHEN n0 = 1 THEN e0 WHEN n1 = 1 THEN e1 WHEN n2 = 1 THEN e2 WHEN n3 = 1 THEN e3 END) AS id FROM n3 GROUP BY 1, 2")
def pick_unique(spark, sf_dir):
    e = _entities(spark, sf_dir)
    first = e.agg(F.min("stage")).first()[0]
    q = _queries(spark, sf_dir).withColumnRenamed("area", "want")
    c = q.join(e, "name").withColumn("qid", F.concat_ws("|", "name", "want"))
    out = resolve.converge(c, "qid", "id", F.col("area") == F.col("want"), F.col("stage") == first, F.col("id") % 2 == 0)
    return out.select(F.split_part("qid", F.lit("|"), F.lit(1)).alias("name"), F.split_part("qid", F.lit("|"), F.lit(2)).alias("area"), "id")


@query("WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w, p_brand AS area FROM part) SELECT q.w, q.area, arg_min(p_partkey, p_partkey) AS id FROM q LEFT JOIN part ON p_brand = q.area AND length(q.w) >= 4 AND length(p_name) >= 4 AND (contains(p_name, q.w) OR contains(q.w, p_name)) GROUP BY 1, 2")
def contains_fallback(spark, sf_dir):
    e = _entities(spark, sf_dir)
    q = e.select(F.split("name", " ")[0].alias("w"), "area").distinct()
    return resolve.containment(q, "w", e, "name", "id", "ord", area="area").select("w", "area", "id")


@query("WITH e AS (SELECT p_partkey AS id, p_name || CASE WHEN p_size % 3 = 0 THEN '（' || p_brand || '校区）' WHEN p_size % 3 = 1 THEN p_brand || '校区' ELSE '' END AS name, p_name AS legal, p_size FROM part) SELECT regexp_replace(legal, '\\s+', '', 'g') AS key, id FROM e")
def family_expand(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    tail = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("（"), "p_brand", F.lit("校区）"))).when(F.col("p_size") % 3 == 1, F.concat("p_brand", F.lit("校区"))).otherwise("")
    e = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", tail).alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("p_partkey").alias("ord"), F.regexp_replace("p_name", r"\s+", "").alias("key"))
    return resolve.family(e.select("key"), "key", e, "name", "aliases", "id", "ord").select("key", "id")


@query("WITH p AS (SELECT a.p_partkey AS q, b.p_partkey AS id, CASE WHEN a.p_name = b.p_name THEN 1000 WHEN split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) THEN 800 ELSE 0 END AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) SELECT q, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM p WHERE score >= 600) WHERE r = 1")
def score_match(spark, sf_dir):
    # equal names have equal first words
    return resolve.first_others(read(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_name", [F.substring_index("p_name", " ", 1)], [1000, 800])


@query("SELECT p_partkey, p_brand || '中学' AS legal, unnest([p_brand || '东校区', p_type || '校区']) AS option FROM part")
def campus_options(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("中学（"), "p_brand", F.lit("东、"), "p_type", F.lit("校区）")).alias("t"))
    return campuses.campus_options(p, "t").select("p_partkey", "legal", "option")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS policy_area FROM customer")
def policy_areas(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    rules = c.filter("c_custkey % 5 = 0").select("c_custkey", (F.col("c_nationkey") + 100).alias("policy_area"))
    return resolve.policy_area(c, rules, "c_custkey", "c_nationkey").select("c_custkey", "policy_area")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS r FROM lineitem) WHERE r = 1")
def best_tier_rows(spark, sf_dir):
    return resolve.best_tier_rows(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag").select("l_orderkey", "l_linenumber")


@query("SELECT p_name AS entity, arg_min(p_brand, (p_size, p_partkey)) AS p_brand FROM part GROUP BY 1")
def group_owner(spark, sf_dir):
    return resolve.owner(read(spark, sf_dir, "part").withColumnRenamed("p_name", "entity"), "entity", "p_brand", "p_size", "p_partkey")


@query("WITH k AS (SELECT p_brand, regexp_replace(p_name, '\\s+', '', 'g') AS k, p_partkey FROM part WHERE p_size < 20), f AS (SELECT k, arg_min(p_brand, p_partkey) AS brand FROM k GROUP BY 1) SELECT p_partkey, brand FROM part LEFT JOIN f ON k = regexp_replace(p_name, '\\s+', '', 'g')")
def brand_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    units = p.filter("p_size < 20").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("uname"), F.array("p_name").alias("unames"), F.col("p_partkey").alias("ord"))
    return resolve.brand_of(p, "p_name", units, "brand", "uname", "unames", "ord").select("p_partkey", "brand")


_AFFIX_NAMES = "SELECT DISTINCT p_brand AS area, CASE p_size % 4 WHEN 0 THEN '天河区' || split_part(p_name, ' ', 1) WHEN 1 THEN split_part(p_name, ' ', 1) || ' 的某一个很长的名字校区' ELSE split_part(p_name, ' ', 1) END AS name FROM part"
_CAMPUS = "(length({0}) BETWEEN 1 AND 8 OR (length({0}) BETWEEN 9 AND 15 AND regexp_matches({0}, '校区|分校|[初高]中部|小学部|本部|中学部|学校')))"


@query(
    f"""WITH n AS ({_AFFIX_NAMES}), p AS (SELECT DISTINCT p_brand AS area, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) || '东校区' END AS p FROM part WHERE p_size > 20)
 SELECT n.area, n.name, coalesce(min(CASE WHEN n.name = p THEN 0 WHEN starts_with(p, n.name) AND {_CAMPUS.format('substr(p, length(n.name) + 1)')} THEN 1
 WHEN ends_with(n.name, p) AND length(p) >= 3 AND regexp_matches(left(n.name, length(n.name) - length(p)), '(区|镇|街道|街)$') THEN 2
 WHEN starts_with(n.name, p) AND {_CAMPUS.format('substr(n.name, length(p) + 1)')} THEN 3 END), 9) AS status FROM n LEFT JOIN p ON n.area = p.area GROUP BY 1, 2"""
)
def affix_status(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("w", F.split("p_name", " ")[0])
    shape = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("天河区"), "w")).when(F.col("p_size") % 4 == 1, F.concat("w", F.lit(" 的某一个很长的名字校区"))).otherwise(F.col("w"))
    names = p.select(F.col("p_brand").alias("area"), shape.alias("name")).distinct()
    points = p.filter("p_size > 20").select(F.col("p_brand").alias("area"), F.when(F.col("p_size") % 2 == 0, F.col("w")).otherwise(F.concat("w", F.lit("东校区"))).alias("p"))
    return resolve.affix_status(names, "name", points, "p", "area")


_STEMS = "SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS w, p_brand, p_size, p_type, p_name FROM part"


def _stems(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ")[0].alias("w"), "p_brand", "p_size", "p_type", "p_name")


@query(
    f"""WITH p AS ({_STEMS}), e AS (SELECT id, CASE WHEN p_size % 2 = 0 THEN w || p_brand ELSE p_brand || w END AS n FROM p), q AS (SELECT DISTINCT w AS q FROM p UNION SELECT n FROM e WHERE id % 3 = 0),
 t AS (SELECT q, min(CASE WHEN n = q THEN id END) AS a, min(CASE WHEN length(n) >= 4 AND length(q) >= 4 AND (starts_with(n, q) OR starts_with(q, n) OR ends_with(n, q) OR ends_with(q, n)) THEN id END) AS b FROM q, e GROUP BY 1)
 SELECT q, coalesce(a, b) AS id FROM t"""
)
def group_match(spark, sf_dir):
    p = _stems(spark, sf_dir)
    e = p.select("id", F.when(F.col("p_size") % 2 == 0, F.concat("w", "p_brand")).otherwise(F.concat("p_brand", "w")).alias("n"))
    q = p.select(F.col("w").alias("q")).union(e.filter("id % 3 = 0").select("n")).distinct()
    return resolve.group_match(q, "q", e, "n", "id", "id")


@query(
    f"""WITH p AS ({_STEMS}), h AS (SELECT p_name AS n, CASE p_size % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'middle' ELSE 'high' END AS stage, p_brand AS area FROM p WHERE p_size > 10),
 f AS (SELECT p.id, count(h.n) AS n, count_if(h.area = p.p_brand) AS own, count_if(h.area = p.p_brand AND h.stage = 'middle') AS good FROM p LEFT JOIN h ON h.n = p.p_name AND h.stage <> 'primary' GROUP BY 1)
 SELECT id AS qid, CASE WHEN own > 0 AND good > 0 THEN 'MATCHED' WHEN own > 0 THEN 'ONLY_HIGH' WHEN n > 0 THEN 'CROSS' ELSE 'MISSING' END AS status FROM f"""
)
def roster_status(spark, sf_dir):
    p = _stems(spark, sf_dir)
    stage = F.when(F.col("p_size") % 3 == 0, "primary").when(F.col("p_size") % 3 == 1, "middle").otherwise("high")
    held = p.filter("p_size > 10").select("id", F.concat("p_name", F.lit("学校")).alias("name"), F.array("p_name").alias("aliases"), stage.alias("stage"), F.col("p_brand").alias("area"))
    official = p.select(F.col("id").alias("qid"), F.col("p_name").alias("name"), F.col("p_brand").alias("area"), F.lit(None).cast("string").alias("campus"), F.lit(True).alias("expected"))
    return resolve.roster_status(official, held).select("qid", "status")


@query(
    f"""WITH p AS ({_STEMS}), o AS (SELECT DISTINCT p_brand AS list, p_name AS name FROM p WHERE p_size < 30), h AS (SELECT p_brand AS list, id, w AS name, p_name AS alias FROM p WHERE p_size > 15)
 SELECT list, 'official_only' AS side, name FROM o WHERE NOT EXISTS (FROM h WHERE h.list = o.list AND (h.name = o.name OR h.alias = o.name))
 UNION ALL SELECT list, 'held_only', name FROM h WHERE NOT EXISTS (FROM o WHERE h.list = o.list AND (h.name = o.name OR h.alias = o.name))"""
)
def listed_gap(spark, sf_dir):
    p = _stems(spark, sf_dir)
    official = p.filter("p_size < 30").select(F.col("p_brand").alias("list"), F.col("p_name").alias("name"))
    held = p.filter("p_size > 15").select(F.col("p_brand").alias("list"), "id", F.col("w").alias("name"), F.array("p_name").alias("aliases"))
    return joins.listed_gap(official, held)


@query(
    f"""WITH p AS ({_STEMS}), l AS (SELECT p_brand, id, p_name FROM p WHERE p_size % 2 = 0 AND NOT EXISTS (FROM p h WHERE h.p_size > 40 AND h.p_brand = p.p_brand AND (h.p_name = p.p_name OR h.w = p.p_name)))
 SELECT l.p_brand AS "group", l.p_name AS member, coalesce(array_to_string(list_sort(list(DISTINCT e.id) FILTER (WHERE e.id IS NOT NULL)), ','), '') AS ids FROM l LEFT JOIN p e ON e.p_name = l.p_name AND e.p_size < 20 GROUP BY l.p_brand, l.p_name, l.id"""
)
def member_gap(spark, sf_dir):
    p = _stems(spark, sf_dir)
    official = p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("group"), F.concat("p_name", F.lit("（"), "w", F.lit("）")).alias("member"))
    held = p.filter("p_size > 40").select(F.col("p_brand").alias("group"), F.concat(F.lit("广州市"), "p_name").alias("member"), F.array("w").alias("campuses"))
    entities = p.filter("p_size < 20").select("id", F.concat("p_name", F.lit("x")).alias("name"), F.array("p_name").alias("aliases"))
    out = joins.member_gap(official, held, entities)
    return out.select("group", F.split("member", "（")[0].alias("member"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(
    f"""WITH p AS ({_STEMS}), rows AS (SELECT id AS row, CASE WHEN p_size % 3 > 0 THEN id END AS id, p_name AS name FROM p WHERE p_size < 30), e AS (SELECT p_name AS name, min(id) AS id FROM p GROUP BY 1),
 t AS (SELECT p.id AS qid, p.p_size, (SELECT max(row) FROM rows r WHERE r.id = p.id) AS t0, (SELECT max(row) FROM rows r WHERE r.id IS NULL AND r.name = p.p_name) AS t1, (SELECT max(row) FROM rows r WHERE r.id = e.id) AS t2, (SELECT min(row) FROM rows r WHERE r.id + 1 = e.id) AS t3 FROM p JOIN e ON e.name = p.p_name)
 SELECT qid, CASE WHEN p_size % 7 <> 0 THEN coalesce(CASE WHEN p_size % 5 = 0 THEN t0 END, t1, t2, t3) END AS row, CASE WHEN p_size % 7 <> 0 THEN CASE WHEN p_size % 5 = 0 AND t0 IS NOT NULL THEN 0 WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 END END AS tier FROM t"""
)
def fact_row(spark, sf_dir):
    """J6 of all parts by a name of their own, which the index and the deny set know, and of those not found by the part's name."""
    p = _stems(spark, sf_dir)
    known = F.col("p_size") % 3 > 0
    rows = p.filter("p_size < 30").select(F.col("id").alias("row"), F.when(known, F.col("id")).alias("id"), F.when(known, F.array(F.col("id") + 1)).alias("ids"), "p_name").withColumnRenamed("p_name", "name")
    own = F.concat("p_name", F.lit("（"), F.col("id").cast("string"), F.lit("）"))
    q = p.select(F.col("id").alias("qid"), "p_size", own.alias("own"), F.col("p_name").alias("name"))
    e = p.select("id", F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("id").alias("ord"))
    index = q.filter("p_size % 5 = 0").select(F.col("own").alias("name"), F.col("qid").alias("id"))
    denied = q.filter("p_size % 7 = 0").select(F.col("own").alias("name"))
    first = resolve.fact_row(q.select("qid", F.col("own").alias("name")), denied, index, rows.filter("id is not null"), e.limit(0)).filter("tier = 0").select("qid", "row", "tier")
    rest = q.join(first, "qid", "left_anti").select("qid", F.when(F.col("p_size") % 7 != 0, F.col("name")).alias("name"))
    return resolve.fact_row(rest, denied, index, rows, e).select("qid", "row", "tier").union(first)


@query(
    f"""WITH p AS ({_STEMS}), s AS (SELECT id, p_name || '小学' AS name, p_brand AS area FROM p WHERE p_size > 30), m AS (SELECT id, w FROM p WHERE p_size < 3),
 q AS (SELECT id AS qid, p_name, p_name || '小学' AS name, p_brand AS area FROM p), t AS (SELECT qid, (SELECT min(id) FROM s WHERE s.name = q.name AND s.area = q.area) AS a, (SELECT min(id) FROM m WHERE contains(replace(q.p_name, ' ', ''), m.w)) AS b, (SELECT min(id) FROM s WHERE s.name = q.name) AS c FROM q)
 SELECT qid, coalesce(a, b, c) AS point, CASE WHEN a IS NULL AND b IS NOT NULL THEN 900 WHEN coalesce(a, c) IS NOT NULL THEN 1000 END AS score, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 END AS round FROM t"""
)
def scored_rounds(spark, sf_dir):
    p = _stems(spark, sf_dir)
    named = F.concat("p_name", F.lit("小学"))
    points = p.filter("p_size > 30").select("id", named.alias("name"), F.lit("学校").alias("kind"), F.col("p_brand").alias("area"), F.col("id").alias("ord"))
    reusable = p.filter("p_size < 3").select("id", F.concat("w", F.lit("初中部")).alias("name"), F.col("id").alias("ord"))
    q = p.select(F.col("id").alias("qid"), named.alias("name"), F.col("p_brand").alias("area"))
    return resolve.scored_rounds(q, points, reusable).select("qid", "point", "score", "round")


def _legal_sites(spark, sf_dir):
    """Each part as a campus of a legal entity that its name and brand stand for."""
    p = _stems(spark, sf_dir)
    legal = F.concat("p_name", F.lit("小学"))
    e = p.select("id", F.concat(legal, F.lit("（"), F.col("id").cast("string"), F.lit("校区）")).alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("primary").alias("stage"), F.col("p_brand").alias("area"), F.lit(None).cast("string").alias("policy_area"), F.col("id").alias("ord"))
    return p.withColumn("legal", legal), e, e.select("name", "id").limit(0)


@query(f"WITH p AS ({_STEMS}) SELECT a.id AS qid, b.id FROM p a JOIN p b ON a.p_name = b.p_name AND (a.p_size % 2 = 1 OR a.p_brand = b.p_brand)")
def legal_campuses(spark, sf_dir):
    p, e, none = _legal_sites(spark, sf_dir)
    q = p.select(F.col("id").alias("qid"), F.col("legal").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("area"), F.lit("primary").alias("stage"))
    return campuses.campuses(q, e, none, {}).select("qid", "id")


@query(f"WITH p AS ({_STEMS}) SELECT a.id AS qid, b.id FROM p a JOIN p b ON a.p_name = b.p_name AND (starts_with(b.id::VARCHAR || '校区', a.id::VARCHAR || '校区') OR starts_with(b.id::VARCHAR || '校区', (a.id + 1)::VARCHAR || '校区'))")
def campus_lists(spark, sf_dir):
    p, e, none = _legal_sites(spark, sf_dir)
    listed = F.concat("legal", F.lit("（"), F.col("id").cast("string"), F.lit("、"), (F.col("id") + 1).cast("string"), F.lit("校区）"))
    q = p.select(F.col("id").alias("qid"), listed.alias("name"), F.lit(None).cast("string").alias("area"), F.lit(None).cast("string").alias("stage"))
    return campuses.campus_sites(q, e, none, {}).select("qid", "id")


@query(
    """WITH g AS (SELECT p_brand AS gid, p_name AS name FROM part WHERE p_size > 25 GROUP BY 1, 2), l AS (SELECT p_name AS name, min(p_size) AS plan FROM part WHERE p_size < 40 GROUP BY 1), n AS (SELECT gid, count(*) AS members FROM g GROUP BY 1)
 SELECT gid, name, plan, 'pool' AS mechanism, members FROM g JOIN n USING (gid) LEFT JOIN l USING (name) UNION ALL SELECT NULL, name, plan, 'zone', NULL FROM l WHERE name NOT IN (SELECT name FROM g)"""
)
def group_plans(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    groups = p.filter("p_size > 25").groupBy(F.col("p_brand").alias("gid")).agg(F.array_sort(F.collect_set(F.concat("p_name", F.lit(" ")))).alias("members"))
    plan = p.filter("p_size < 40").groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").alias("plan"))
    return feeds.group_plans(groups, plan, "pool", "zone").withColumn("members", F.size("members")).withColumn("name", F.trim("name"))


@query(
    """WITH q AS (SELECT p_partkey AS qid, p_name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || '（初中部）' END AS name FROM part), r AS (SELECT p_partkey AS row, p_name, p_size % 3 AS kind FROM part WHERE p_size < 30 AND p_size % 4 > 0),
 t AS (SELECT qid, row, CASE WHEN q.p_name = q.name OR kind = 1 THEN 0 ELSE 1 END AS tier FROM q JOIN r USING (p_name)), b AS (SELECT *, min(tier) OVER (PARTITION BY qid) AS best FROM t) SELECT qid, row FROM b WHERE tier = best"""
)
def year_rows(spark, sf_dir):
    """J35 of all parts' names, half of them with a later year's suffix, among names a third of which have it too."""
    p = read(spark, sf_dir, "part")
    later = F.concat("p_name", F.lit("（初中部）"))
    q = p.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(later).alias("name"))
    rows = p.filter("p_size < 30 and p_size % 4 > 0").select(F.col("p_partkey").alias("row"), F.when(F.col("p_size") % 3 == 1, later).otherwise(F.col("p_name")).alias("name"))
    none = q.limit(0)
    return feeds.year_rows(q, rows, none.select("name", F.col("name").alias("other"), F.col("qid").alias("ord")), none)


# --- sequence
@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def first_by_key(spark, sf_dir):
    return sequence.first_by_key(read(spark, sf_dir, "part"), "p_name", ["p_partkey"]).select("p_name", "p_partkey")


@query(f"SELECT min(id) AS id FROM (SELECT c_custkey AS id, c_mktsegment AS s, {PLACE.format('c_custkey % 50')} FROM customer) GROUP BY s, floor(lng * 10 + 0.5), floor(lat * 10 + 0.5)")
def first_by_place(spark, sf_dir):
    c = placed(read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 50), "k")
    return sequence.first_by_place(c, "c_mktsegment", "lng", "lat", "c_custkey", 1).select(F.col("c_custkey").alias("id"))


@query("SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def forward_fill(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return sequence.forward_fill(e, "user_id", "event_id", "v", "filled").select("event_id", "filled")


@query("SELECT conv_id, turn, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS section FROM conversations")
def running_group(spark, sf_dir):
    return sequence.attach_to_header(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "section")


@query("WITH s AS (SELECT *, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS section FROM conversations) SELECT conv_id, section, md5(string_agg(coalesce(text, ''), '|' ORDER BY turn, text)) AS joined, count(*)::INT AS lines FROM s GROUP BY 1, 2")
def stitched_lines(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return sequence.stitch(c, "conv_id", "turn", F.col("role") == "user", "text", "|").select("conv_id", "section", F.md5("text").alias("joined"), "lines")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events")
def kth_counter(spark, sf_dir):
    return sequence.nth_of_key(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "k")


# --- order
@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 2 = 1, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END DESC NULLS LAST, s_suppkey) AS down, row_number() OVER (ORDER BY s_suppkey % 2 = 1, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END ASC NULLS LAST, s_suppkey) AS up FROM supplier")
def rank_nulls_last(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    last, metric = F.col("s_suppkey") % 2 == 1, F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal"))
    down = ranking.ranked(s, ranking.metric_order(last, metric, ["s_suppkey"]), "down").select("s_suppkey", "down")
    return down.join(ranking.ranked(s, ranking.metric_order(last, metric, ["s_suppkey"], False), "up").select("s_suppkey", "up"), "s_suppkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(CASE WHEN p_size < 30 THEN p_size END, 99), p_retailprice DESC, p_partkey) AS rank FROM part")
def rank_by_level(spark, sf_dir):
    level = F.when(F.col("p_size") < 30, F.col("p_size"))
    return ranking.ranked(read(spark, sf_dir, "part"), ranking.level_order(level, F.desc("p_retailprice"), F.col("p_partkey")), within=["p_brand"]).select("p_partkey", "rank")


@query("WITH s AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE n_name END AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey), n AS (SELECT g, row_number() OVER (ORDER BY CASE WHEN g IS NULL THEN 4 WHEN g = 'NATION_7' THEN 1 WHEN g = 'NATION_3' THEN 2 ELSE 3 END, g) AS group_no FROM (SELECT DISTINCT g FROM s)) SELECT s_suppkey, group_no, row_number() OVER (PARTITION BY s.g ORDER BY s_acctbal DESC, s_suppkey) AS place FROM s JOIN n ON s.g IS NOT DISTINCT FROM n.g")
def group_order(spark, sf_dir):
    s = joins.lookup(read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), read(spark, sf_dir, "nation"), "n_nationkey")
    s = s.withColumn("g", F.when(F.col("s_suppkey") % 4 != 0, F.col("n_name")))
    return ranking.grouped(s, "g", ["NATION_7", "NATION_3"], [F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "group_no", "place")


@query("SELECT c_name, (length(c_name) * 0)::INT AS z FROM customer WHERE contains(c_name, '9') ORDER BY c_name <> '9', coalesce(c_nationkey, 9), c_name LIMIT 20")
def suggestion_list(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("stage", F.lit(1))
    return ranking.suggestions(c, "9", "c_name", "c_nationkey", "stage").select("c_name", F.lit(0).alias("z"))


@query("SELECT p_name, substr(p_name, 1, 2) AS sort_key FROM part GROUP BY 1")
def recommendation_list(spark, sf_dir):
    return ranking.recommendations(read(spark, sf_dir, "part"), "p_name", "p_partkey", F.substring("p_name", 1, 2))


@query("SELECT o_custkey, array_to_string(list_filter(['P', 'O', 'F'], lambda x: list_contains(s, x)), '') AS ordered FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)")
def canonical_order(spark, sf_dir):
    s = A.value_set(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")
    return s.select("o_custkey", F.array_join(ranking.canonical_order("values", ["P", "O", "F"]), "").alias("ordered"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 5")
def topk_per_group(spark, sf_dir):
    return ranking.top_k(read(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5).select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("SELECT l_suppkey, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*), 4) AS metric FROM lineitem GROUP BY 1")
def metric_switch(spark, sf_dir):
    metrics = {"mean": F.round(F.sum(F.col("l_quantity").cast(MONEY)).cast("double") / F.count("*"), 4), "rows": F.count("*")}
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(ranking.metric_switch(metrics, "mean").alias("metric"))


# --- sets
@query("SELECT c_custkey AS k, 'customer' AS tag FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_all_tag(spark, sf_dir):
    return sets.union_tagged({"customer": read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "supplier": read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))}, "tag")


@query("SELECT c_name AS name, c_acctbal AS amount, c_mktsegment AS kind FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_mapped(spark, sf_dir):
    return sets.union_mapped([(read(spark, sf_dir, "customer"), {"name": "c_name", "amount": "c_acctbal", "kind": "c_mktsegment"}), (read(spark, sf_dir, "supplier"), {"name": "s_name", "amount": F.col("s_acctbal")})], ["name", "amount", "kind"])


@query("WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber < 3), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber > 1) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def two_way_diff(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    return sets.two_way_difference(l.filter("l_linenumber < 3").select("l_suppkey", "l_partkey"), l.filter("l_linenumber > 1").select("l_suppkey", "l_partkey"))


@query("WITH d AS (SELECT p_name, p_brand, sum(CASE WHEN p_size < 25 THEN -1 ELSE 1 END)::BIGINT AS delta FROM part GROUP BY 1, 2) SELECT *, CASE WHEN delta > 0 THEN '+' ELSE '-' END AS change FROM d WHERE delta <> 0")
def snapshot_diff(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return sets.snapshot_diff(p.filter("p_size < 25").select("p_name", "p_brand"), p.filter("p_size >= 25").select("p_name", "p_brand"))


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN a.v = b.v THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.k = b.k")
def value_compare(spark, sf_dir):
    side = lambda s: read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    return sets.compare_values(side("F"), side("O"), "k", "v")


@query("SELECT n_nationkey, n_regionkey < 3 AS equal FROM nation")
def deep_equality(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    other = n.select("n_nationkey", F.when(F.col("n_regionkey") < 3, F.col("n_regionkey")).otherwise(-1).alias("n_regionkey"), "n_name")
    return sets.deep_equal(n, other, "n_nationkey")


@query("WITH l AS (SELECT o_custkey AS k, o_orderstatus AS path, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), r AS (SELECT o_custkey AS k, o_orderstatus AS path, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2) SELECT coalesce(l.k, r.k) AS k, coalesce(l.path, r.path) AS path, l.n AS \"left\", r.n AS \"right\" FROM l FULL JOIN r ON l.k = r.k AND l.path = r.path WHERE l.n IS DISTINCT FROM r.n")
def nested_map_diff(spark, sf_dir):
    def side(odd):
        n = read(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("k"), "o_orderstatus").agg(F.count("*").alias("n"))
        return n.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("cells"))

    return sets.nested_diff(side(0), side(1), "k", "cells")


@query("WITH f AS (SELECT p_name, list(DISTINCT p_size) AS s FROM part GROUP BY 1), c AS (SELECT p_partkey, p_size, list_sort(list_filter(s, lambda x: x IN (1, 2, 3, 4, 5))) AS b FROM part JOIN f USING (p_name)) SELECT p_partkey, CASE WHEN len(b) > 0 AND NOT (len(b) = 1 AND list_contains(b, p_size)) THEN array_to_string(b, ',') END AS ids FROM c")
def confirmed_family(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    f = p.groupBy("p_name").agg(F.collect_set("p_size").alias("s"))
    known = F.array(*[F.lit(k) for k in range(1, 6)])
    return p.join(f, "p_name").select("p_partkey", F.array_join(sets.confirmed("s", known, "p_size").cast("array<string>"), ",").alias("ids"))


# --- graph
@query("WITH e AS (SELECT DISTINCT l_partkey AS target, l_returnflag, l_suppkey AS s FROM lineitem) SELECT target, l_returnflag, array_to_string(list_sort(list(s)), ',') AS sources FROM e GROUP BY 1, 2")
def edge_reverse(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.array("l_suppkey").alias("a"), F.array("l_partkey").alias("b"), "l_returnflag")
    return graph.reverse_edges(l, "a", "b", "l_returnflag").withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS members FROM orders GROUP BY 1")
def feed_union(spark, sf_dir):
    m = A.union_maps(read(spark, sf_dir, "orders").select("o_custkey", F.create_map("o_orderstatus", F.array("o_orderpriority")).alias("m")), "o_custkey", "m")
    return m.select("o_custkey", F.array_join(F.array_sort(graph.flat_members("m")), ",").alias("members"))


@query("SELECT r_regionkey, r_name AS k, string_agg(n_name, ',' ORDER BY n_nationkey) AS v FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def named_members(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    m = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ids"))
    r = read(spark, sf_dir, "region").join(m, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.create_map("r_name", "ids").alias("m"))
    return graph.named_members(r, "r_regionkey", "m", n, "n_nationkey", "n_name").select("r_regionkey", F.explode("m").alias("k", "v")).select("r_regionkey", "k", F.array_join("v", ",").alias("v"))


@query("WITH e AS (SELECT l_orderkey AS k, l_returnflag AS kind, l_suppkey AS t FROM lineitem WHERE l_linenumber <> 2), g AS (SELECT k, kind, array_to_string(list_sort(list(DISTINCT t)), ',') AS targets, CASE kind WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 9 END AS priority FROM e GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, kind) AS place FROM g")
def route_groups(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("t"), F.when(F.col("l_linenumber") == 2, F.col("l_suppkey")).alias("d"))
    return graph.route_groups(e, "k", "kind", "t", "d", {"R": 1, "A": 2}).withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE n_name END AS v FROM customer JOIN nation ON c_nationkey = n_nationkey")
def backfill_missing(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("v"))
    return graph.backfill(c, read(spark, sf_dir, "nation").withColumnRenamed("n_name", "v"), "n_nationkey", "v").select("c_custkey", "v")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN n_name ELSE c_mktsegment END AS v FROM customer JOIN nation ON c_nationkey = n_nationkey")
def override_values(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("v"))
    return graph.override(c, read(spark, sf_dir, "nation").filter("n_nationkey < 10").withColumnRenamed("n_name", "v"), "n_nationkey", "v").select("c_custkey", "v")


@query("SELECT p_name, min(p_partkey) AS id FROM part WHERE p_size < 5 GROUP BY 1 UNION ALL SELECT p_name, min(p_partkey) FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 5) GROUP BY 1")
def carry_over(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    one = lambda df: df.groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return graph.carry_over(one(p.filter("p_size < 5")), one(p), "p_name")


@query("WITH f AS (SELECT p_brand, p_name, p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS m FROM part), k AS (SELECT *, coalesce(m::VARCHAR, 'name:' || p_name) AS k FROM f) SELECT p_brand, arg_min(m, p_partkey) AS dummy, min(p_partkey) AS first FROM k GROUP BY p_brand, k.k")
def member_rows(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("ids", F.when(F.col("p_size") % 2 == 0, F.array("p_size")))
    out = graph.member_rows(p, "p_brand", "ids", "p_name", "p_partkey")
    return out.select("p_brand", F.col("member_id").alias("dummy"), F.col("p_partkey").alias("first"))


@query("WITH core AS (SELECT p_brand, p_name, max(p_size) AS cov FROM part WHERE p_size > 40 GROUP BY 1, 2), mem AS (SELECT p_brand, p_name, sum(p_size)::BIGINT AS cov FROM part WHERE p_size <= 40 GROUP BY 1, 2) SELECT core.p_brand, core.p_name, core.cov + coalesce(mem.cov, 0) AS cov, 'core' AS role FROM core LEFT JOIN mem USING (p_brand, p_name) UNION ALL SELECT p_brand, p_name, cov, 'member' FROM mem WHERE (p_brand, p_name) NOT IN (SELECT (p_brand, p_name) FROM core)")
def fold_core(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    core = p.filter("p_size > 40").groupBy("p_brand", "p_name").agg(F.max("p_size").cast("long").alias("cov"))
    member = p.filter("p_size <= 40").groupBy("p_brand", "p_name").agg(F.sum("p_size").alias("cov"))
    return graph.fold_core(member, core, "p_brand", "p_name", "cov")


@query("SELECT c_custkey AS k, CASE WHEN c_mktsegment LIKE 'A%' THEN c_mktsegment ELSE 'A' || c_mktsegment END AS pre, split_part(c_name, '0', 1) AS head FROM customer")
def patch_text(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), graph.prefixed(F.col("c_mktsegment"), "A").alias("pre"), graph.until_marker(F.col("c_name"), "0").alias("head"))


@query("WITH cur AS (SELECT c_custkey AS k, c_acctbal AS v, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE 'other' END AS src FROM customer), inc AS (SELECT c_custkey AS k, -1.0::DOUBLE AS v FROM customer WHERE c_custkey % 3 = 0) SELECT k, v, src FROM cur WHERE k NOT IN (SELECT k FROM inc) AND src <> 'own' UNION ALL SELECT k, v, 'own' FROM inc")
def upsert_owned(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    current = c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.when(F.col("c_custkey") % 2 == 0, "own").otherwise("other").alias("src"))
    return graph.upsert_owned(current, c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit(-1.0).alias("v")), "k", "src", "own")


@query("SELECT p_brand, p_name, arg_min(p_partkey, ((p_size <> 7)::INT, p_partkey)) AS p_partkey FROM part GROUP BY 1, 2")
def alias_owner(spark, sf_dir):
    return graph.alias_owner(read(spark, sf_dir, "part").withColumn("forced", F.col("p_size") == 7), "p_brand", "p_name", "p_partkey", "forced", "p_partkey")


@query("WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '白云' || p_name ELSE p_name END AS alias FROM part), r AS (SELECT *, regexp_replace(alias, '^(白云|越秀)', '') AS rest FROM a), o AS (SELECT rest, count(DISTINCT id) AS n FROM r GROUP BY 1) SELECT id, alias FROM r JOIN o USING (rest) WHERE NOT regexp_matches(alias, '^(白云|越秀)') OR n > 1 OR alias IN (SELECT alias FROM a WHERE id % 10 = 0)")
def slim_aliases(spark, sf_dir):
    a = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("白云"), "p_name")).otherwise(F.col("p_name")).alias("alias"))
    return graph.slim_aliases(a, "alias", "id", ["白云", "越秀"], a.filter("id % 10 = 0"))


@query("SELECT p_partkey, pos, item, CASE WHEN pos = 0 THEN p_brand ELSE '' END AS p_brand FROM (SELECT p_partkey, p_brand, unnest(range(len(string_split(p_name, ' '))))::INT AS pos, unnest(string_split(p_name, ' ')) AS item FROM part)")
def label_first_row(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("items"))
    return graph.label_first(p, "p_partkey", "items", "p_brand")


@query("WITH r AS (SELECT o_custkey AS id, min(o_orderkey) AS ord FROM orders GROUP BY 1) SELECT id, ord, NULL AS gap FROM r UNION ALL SELECT c_custkey, NULL, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey NOT IN (SELECT id FROM r)")
def feed_build(spark, sf_dir):
    resolved = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"))
    points = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area"))
    reasons = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("reason"))
    return graph.feed_build(resolved, points, reasons, "id", "ord", "area").select("id", "ord", "gap")


@query("SELECT 'gz-' || p_size::VARCHAR || '-' || substr(sha1(p_size::VARCHAR || '|' || p_name), 1, 8) AS sid, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_size, p_name, p_type")
def entity_build(spark, sf_dir):
    return graph.build_entities(read(spark, sf_dir, "part"), "p_size", F.col("p_name"), "p_type", "sid", "p_partkey").select("sid", "p_type", "p_partkey")


@query("SELECT doc_id, trim(regexp_extract(line, '^([^:：]+)[:：]', 1)) AS label FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(regexp_extract(line, '^([^:：]+)[:：]', 1)) <> ''")
def labelled_lines(spark, sf_dir):
    return graph.labelled_lines(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "label")


# --- quality
@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'red|blue')")
def dq_forbidden(spark, sf_dir):
    return quality.forbidden_words(read(spark, sf_dir, "part"), "p_name", ["red", "blue"]).select("p_partkey")


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicates(spark, sf_dir):
    return quality.duplicate_keys(read(spark, sf_dir, "part"), ["p_name", "p_brand"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def dq_dangling(spark, sf_dir):
    dim = read(spark, sf_dir, "part").filter("p_size > 3").select(F.col("p_partkey").alias("l_partkey"))
    return quality.dangling(read(spark, sf_dir, "lineitem"), dim, "l_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT p_name, p_brand, count(DISTINCT p_partkey) AS entities FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) > 1 AND NOT bool_or(p_size % 10 = 0)")
def dq_ambiguous(spark, sf_dir):
    return quality.ambiguous_aliases(read(spark, sf_dir, "part"), ["p_name", "p_brand"], "p_partkey", F.col("p_size") % 10 == 0)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (3, 6)")
def dq_empty_lists(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("v"))
    return quality.empty_lists(read(spark, sf_dir, "customer").join(o, "c_custkey", "left"), "c_custkey", "v", [3, 6]).select("c_custkey")


@query("SELECT s_suppkey FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey <> c_nationkey")
def dq_area_mismatch(spark, sf_dir):
    facts = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("area"))
    dim = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("area"))
    return quality.area_mismatch(facts, dim, "s_suppkey", "area").select("s_suppkey")


@query("SELECT p_name, count(DISTINCT p_brand) AS areas FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def dq_cross_area(spark, sf_dir):
    return quality.cross_area_keys(read(spark, sf_dir, "part"), "p_name", "p_brand")


@query("WITH p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT c_custkey AS k, array_to_string(list_filter([CASE WHEN c_custkey NOT IN (SELECT * FROM p) THEN 'part' END, CASE WHEN c_custkey NOT IN (SELECT * FROM f) THEN 'full' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer WHERE c_nationkey < 10 AND (c_custkey NOT IN (SELECT * FROM p) OR c_custkey NOT IN (SELECT * FROM f))")
def dq_orphans(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    c = read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    return quality.orphans(c, "k", {"part": o.filter("o_orderstatus = 'P'"), "full": o.filter("o_orderstatus = 'F'")}, F.col("c_nationkey") < 10)


@query("SELECT 'rows' AS what, count(*)::DOUBLE AS got, 25.0::DOUBLE AS expected, count(*) = 25 AS ok FROM nation UNION ALL SELECT 'keys', sum(n_nationkey)::DOUBLE, 300.0, sum(n_nationkey) = 300 FROM nation")
def dq_totals(spark, sf_dir):
    return quality.totals(read(spark, sf_dir, "nation"), {"rows": F.lit(1), "keys": F.col("n_nationkey")}, {"rows": 25, "keys": 300})


@query("SELECT count(*) AS rows_before, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_before, count(*) AS rows_after, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_after FROM lineitem")
def dq_conservation(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    out = quality.conservation(l, l.filter("l_returnflag = 'R'").union(l.filter("l_returnflag <> 'R'")), "l_quantity")
    return out.withColumn("sum_before", F.col("sum_before").cast("double")).withColumn("sum_after", F.col("sum_after").cast("double"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_custkey NOT IN (1, 2)")
def dq_excluded(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return quality.excluded_present(read(spark, sf_dir, "orders"), c, "o_custkey", [1, 2]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def dq_accepted(spark, sf_dir):
    return quality.not_accepted(read(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey")


@query("SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AND count(*) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY 1")
def dq_contiguous(spark, sf_dir):
    return quality.contiguous(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(_PARTS + ", r AS (SELECT name, min(id) AS got FROM e GROUP BY 1) SELECT id, got AS resolved FROM e JOIN r USING (name) WHERE id <> got")
def dq_round_trip(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return quality.round_trip(e, e.groupBy("name").agg(F.min("id").alias("id")), "name", "id").select("id", "resolved")


# --- further lookups
@query(
    f"""WITH r AS (SELECT c_mktsegment AS line, 'S' || (c_custkey % 40)::VARCHAR AS name, c_custkey AS id, {PLACE.format('c_custkey')} FROM customer),
 f AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'none' END AS line, 'S' || (s_suppkey % 30)::VARCHAR AS name, s_suppkey AS ord, {PLACE.format('s_suppkey')} FROM supplier),
 a AS (SELECT line, name, arg_min(lng, ord) AS l1, arg_min(lat, ord) AS a1 FROM f GROUP BY 1, 2),
 b AS (SELECT name, arg_min(lng, ord) AS l2, arg_min(lat, ord) AS a2, min(lng) AS x1, max(lng) AS x2, min(lat) AS y1, max(lat) AS y2 FROM f GROUP BY 1)
 SELECT id, coalesce(l1, l2, lng) AS lng, coalesce(a1, a2, lat) AS lat, CASE WHEN l1 IS NOT NULL THEN 'line' WHEN l2 IS NOT NULL THEN 'name' ELSE 'kept' END AS tier,
 l1 IS NULL AND coalesce(2 * 6371000 * asin(sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))) > 1500, false) AS conflict
 FROM r LEFT JOIN a USING (line, name) LEFT JOIN b USING (name)"""
)
def refresh_places(spark, sf_dir):
    r = placed(read(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("line"), F.concat(F.lit("S"), (F.col("c_custkey") % 40).cast("string")).alias("name"), "lng", "lat")
    f = placed(read(spark, sf_dir, "supplier"), "s_suppkey").select(F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("none").alias("line"), F.concat(F.lit("S"), (F.col("s_suppkey") % 30).cast("string")).alias("name"), F.col("s_suppkey").alias("ord"), "lng", "lat")
    return joins.refresh_tiered(r, f, "line", "name", "ord", 1500.0).select("id", "lng", "lat", "tier", "conflict")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = c_nationkey THEN c_custkey END AS entity FROM supplier JOIN customer ON s_suppkey = c_custkey")
def verified_area(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_custkey").alias("entity"), "c_nationkey")
    out = read(spark, sf_dir, "supplier").join(c, "s_suppkey")
    return resolve.verified_area(out, "entity", "c_nationkey", "s_nationkey").select("s_suppkey", "entity")


@query("SELECT a.p_partkey AS key, arg_min(b.p_size, b.p_partkey) AS level FROM part a JOIN part b ON a.p_name = b.p_name AND b.p_size < 6 GROUP BY 1")
def level_lookup(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    levels = p.filter("p_size < 6").select(F.col("p_name").alias("name"), F.col("p_size").alias("level"), F.col("p_partkey").alias("ord"))
    return resolve.first_level(p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), "key", levels, "name", "level", "ord")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'none' WHEN p_size * 20 >= 900 THEN 'same' WHEN p_retailprice <= 1000 THEN 'near' ELSE 'far' END AS class FROM part")
def candidate_class(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("score", F.when(F.col("p_size") >= 10, F.col("p_size") * 20))
    return p.select("p_partkey", resolve.classified(p, "score", "p_retailprice", 900, 1000.0).alias("class"))


@query("SELECT n_regionkey, unnest(list_sort(list(n_nationkey))) AS member, count(*)::INT AS size FROM nation GROUP BY 1")
def expand_members(spark, sf_dir):
    groups = A.value_set(read(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")
    return A.expand_members(groups, "values").select("n_regionkey", "member", F.size("values").alias("size"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE regexp_matches((l_linenumber * 3)::VARCHAR, '^\\d+$') AND l_quantity IS NOT NULL")
def data_rows(spark, sf_dir):
    """Table rows that start with a number, null cells dropped."""
    l = read(spark, sf_dir, "lineitem").withColumn("cells", F.create_map(F.lit("no"), (F.col("l_linenumber") * 3).cast("string"), F.lit("gap"), F.lit(None).cast("string")))
    kept = l.withColumn("cells", filters.drop_null_cells("cells"))
    return kept.filter(filters.data_row(F.col("cells")["no"]) & (F.size("cells") == 1)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name LIKE 'a%' AND NOT contains(p_name, 'ed') AS gate, len(string_split(p_name, ' ')) - 1 AS separators, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'middle' ELSE 'small' END AS rule FROM part")
def name_gates(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    gate = p["p_name"].startswith("a") & filters.keyword_gate(F.col("p_name"), ["a"], ["ed"])
    return p.select("p_partkey", gate.alias("gate"), filters.count_separators(F.col("p_name"), " ").cast("long").alias("separators"), filters.first_rule([(F.col("p_size") > 40, "large"), (F.col("p_size") > 20, "middle")], "small").alias("rule"))


@query("SELECT p_partkey, p_brand IN ('Brand#1', 'Brand#2') AND p_name <> 'x' AS listed FROM part")
def listed_campuses(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    campus = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("（东校区）"))).otherwise(F.col("p_brand"))
    return p.select("p_partkey", filters.listed_or_campus(campus, ["Brand#1", "Brand#2"], ["x"]).alias("listed"))
