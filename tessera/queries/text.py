"""Normalisers and extractors over names made from parts (ambiguous on purpose), both engines building the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import names as N
from tessera.queries.registry import query, read

# Names of eight shapes, by key; the suffix keeps them apart.
SHAPES = [
    "concat('广州市', p_brand, '中学（', p_type, '校区）')",
    "concat('广东', p_name, '学校(高中部)')",
    "concat('广州', p_brand, '小学')",
    "concat('白云区', p_name, '实验学校 初中部')",
    "concat('第', p_size, '中学　', p_brand)",
    "concat('2026年', p_name, '（', p_brand, '）（', p_type)",
    "concat(p_brand, ' ', p_name)",
    "concat('特控率', p_size, '%，说明', p_size, '.')",
]
NAME_SQL = "CASE " + " ".join(f"WHEN p_partkey % 8 = {k} THEN {s}" for k, s in enumerate(SHAPES)) + " END"
NAMES = f"WITH names AS (SELECT p_partkey AS id, {NAME_SQL} AS name FROM part) "


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(NAME_SQL).alias("name"))


def _each(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    return _names(spark, sf_dir).select("id", column.alias("out"))


def _sql(expression: str) -> str:
    return NAMES + f"SELECT id, {expression} AS out FROM names"


_BRACKETS = "replace(replace(name, '（', '('), '）', ')')"
_STRICT = f"regexp_replace(replace(replace(replace({_BRACKETS}, '广州市', ''), '(', ''), ')', ''), '[\\s　]+', '', 'g')"
_SPACES = "replace(replace(replace(replace(replace(replace(replace({0}, '广州市', ''), '[', ''), ']', ''), '(', ''), ')', ''), ' ', ''), '　', '')".format(_BRACKETS)
_LOOSE = "(初中部|高中部|小学部|校区|分校|学校|部)$"


@query(_sql(_STRICT))
def norm_strict(spark, sf_dir):
    return _each(spark, sf_dir, N.strict_norm(F.col("name")))


@query(_sql(_SPACES))
def norm_strict_spaces(spark, sf_dir):
    return _each(spark, sf_dir, N.strict_norm_spaces(F.col("name")))


@query(_sql(f"regexp_replace(regexp_replace({_BRACKETS}, '^广州市', ''), '[()\\s　]', '', 'g')"))
def norm_prefix(spark, sf_dir):
    return _each(spark, sf_dir, N.prefix_norm(F.col("name")))


@query(_sql(f"regexp_replace({_STRICT}, '{_LOOSE}', '')"))
def norm_loose(spark, sf_dir):
    return _each(spark, sf_dir, N.loose_norm(F.col("name")))


@query(_sql(f"regexp_replace({_SPACES}, '(.){_LOOSE}', '\\1')"))
def norm_loose_keep(spark, sf_dir):
    return _each(spark, sf_dir, N.loose_norm(F.col("name"), keep_one=True))


@query(_sql("replace(replace(replace(replace(replace(replace(replace(replace({0}, '广州市', ''), '广州', ''), '[', ''), ']', ''), '(', ''), ')', ''), ' ', ''), '　', '')".format(_BRACKETS)))
def norm_brand(spark, sf_dir):
    return _each(spark, sf_dir, N.brand_norm(F.col("name")))


_CORE = "trim(regexp_replace(name, '[（(][^）)]*[）)]', '', 'g'))"


@query(_sql(_CORE))
def core_campus(spark, sf_dir):
    return _each(spark, sf_dir, N.core_campus_name(F.col("name")))


_GEN = "'实验中学','附属实验学校','外国语实验学校','实验学校','外国语学校','附属中学','中学','附属小学','小学','学校','初中部','小学部','高中部'"


def _generic_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[\\(\\[].*$', ''), '^第?[一二三四五六七八九十0-9]+', ''), '^(实验|附属|外国语|外语)', '') IN ({_GEN})"


_MATCH = (
    NAMES
    + f""", a AS (SELECT id, regexp_replace(replace(trim({_BRACKETS}), '广州市', ''), '(越秀|海珠|天河|荔湾|白云|黄埔|番禺|南沙|增城|从化|花都|萝岗)区', '\\1', 'g') AS t FROM names),
 b AS (SELECT id, CASE WHEN regexp_matches(t, '^(白云|越秀|海珠|天河|荔湾|黄埔|番禺|萝岗)') AND length(substr(t, 3)) >= 4 AND NOT ({_generic_sql('substr(t, 3)')}) THEN substr(t, 3) ELSE t END AS t FROM a),
 c AS (SELECT id, CASE WHEN t LIKE '广州%' AND length(substr(t, 3)) >= 4 AND NOT ({_generic_sql('substr(t, 3)')}) THEN substr(t, 3) ELSE t END AS t FROM b)
 SELECT id, regexp_replace(t, '[\\s　]+', '', 'g') AS out FROM c"""
)


@query(_MATCH)
def norm_match(spark, sf_dir):
    return _each(spark, sf_dir, N.match_norm(F.col("name")))


@query(_sql(f"({_generic_sql('name')})"))
def generic_core(spark, sf_dir):
    return _each(spark, sf_dir, N.is_generic_core(F.regexp_replace("name", r"[\(\[].*$", "")))


_PLAIN = "regexp_replace(regexp_replace(regexp_replace({0}, '（[^）]*）', '', 'g'), '\\([^)]*\\)', '', 'g'), '{1}', '')"


@query(_sql("trim(" + _PLAIN.format("regexp_replace(name, '^(广州市|广州)', '')", "(小学|学校|校区|中学|初中)$") + ")"))
def norm_plain(spark, sf_dir):
    return _each(spark, sf_dir, N.plain_school_name(F.col("name")))


@query(_sql("trim(" + _PLAIN.format("name", "(初中部|高中部|小学部)$") + ")"))
def norm_base(spark, sf_dir):
    return _each(spark, sf_dir, N.base_name(F.col("name")))


@query(_sql("regexp_replace(regexp_extract(name, '（([^）]+)）', 1), '校区$', '')"))
def campus_label(spark, sf_dir):
    return _each(spark, sf_dir, N.campus_short(F.col("name")))


_SHORT = "CASE WHEN trim(name) LIKE '广州市%' THEN substr(trim(name), 4) WHEN trim(name) LIKE '广东%' THEN substr(trim(name), 3) WHEN trim(name) LIKE '广州%' AND length(substr(trim(name), 3)) >= 3 AND substr(trim(name), 3) NOT LIKE '大学%' THEN substr(trim(name), 3) ELSE trim(name) END"


@query(_sql(_SHORT))
def short_names(spark, sf_dir):
    return _each(spark, sf_dir, N.short_name(F.col("name")))


@query(
    NAMES
    + f""", s AS (SELECT id, name, {_SHORT} AS short, CASE WHEN name LIKE '广东%' THEN '广东' WHEN name LIKE '广州%' AND name NOT LIKE '广州市%' THEN '广州' ELSE '' END AS prefix FROM names),
 k AS (SELECT *, trim(regexp_replace(regexp_replace(short, '（[^）]*）|\\([^)]*\\)', '', 'g'), '\\s+', '', 'g')) AS key FROM s),
 a AS (SELECT key FROM k GROUP BY key HAVING bool_or(prefix = '广东') AND bool_or(prefix = '广州'))
 SELECT id, CASE WHEN key IN (SELECT key FROM a) THEN name ELSE short END AS out FROM k"""
)
def ambiguous_short_names(spark, sf_dir):
    """The full name where both subjects shorten to the same key."""
    k = _names(spark, sf_dir).withColumn("short", N.short_name(F.col("name"))).withColumn("prefix", N.subject_prefix(F.col("name")))
    k = k.withColumn("key", F.trim(F.regexp_replace(F.regexp_replace("short", r"（[^）]*）|\([^)]*\)", ""), r"\s+", "")))
    both = k.groupBy("key").agg((F.max((F.col("prefix") == "广东").cast("int")) + F.max((F.col("prefix") == "广州").cast("int"))).alias("n")).filter("n = 2")
    return k.join(both, "key", "left").select("id", F.when(F.col("n") == 2, F.col("name")).otherwise(F.col("short")).alias("out"))


INITIALS = {"广": "g", "东": "d", "州": "z", "实": "s", "验": "y", "中": "z", "学": "x", "第": "d", "小": "x", "市": "s", "校": "x", "区": "q"}


@query(_sql(f"translate(substr(regexp_replace(name, '[^{''.join(INITIALS)}]', '', 'g'), 1, 6), '{''.join(INITIALS)}', '{''.join(INITIALS.values())}')"))
def initials(spark, sf_dir):
    return _each(spark, sf_dir, N.initials_key(F.col("name"), INITIALS))


_TENS = "(CASE WHEN n >= 20 THEN substr('一二三四五六七八九', n // 10, 1) ELSE '' END) || (CASE WHEN n >= 10 THEN '十' ELSE '' END) || (CASE WHEN n % 10 > 0 THEN substr('一二三四五六七八九', n % 10, 1) ELSE '' END)"


@query(f"WITH k AS (SELECT p_partkey AS id, p_partkey % 130 AS n FROM part) SELECT id, CASE WHEN n = 0 THEN '0中学' WHEN n >= 100 THEN '第' || translate(n::VARCHAR, '123456789', '一二三四五六七八九') || '中学' ELSE '第' || {_TENS} || '中学' END AS out FROM k")
def ordinals(spark, sf_dir):
    key = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat((F.col("p_partkey") % 130).cast("string"), F.lit("中学")).alias("s"))
    return key.select("id", N.chinese_ordinal(F.col("s")).alias("out"))


@query("SELECT p_partkey AS id, (p_partkey % 25)::INT AS out FROM part WHERE p_partkey % 25 BETWEEN 1 AND 19")
def chinese_numbers(spark, sf_dir):
    """The numerals 一 to 十九, made by rule, read back."""
    key = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).cast("int").alias("n")).filter("n between 1 and 19")
    ones = F.when(F.col("n") % 10 > 0, F.substring(F.lit(N.NUMERALS), (F.col("n") % 10).cast("int"), F.lit(1))).otherwise("")
    text = F.concat(F.when(F.col("n") >= 10, "十").otherwise(""), ones)
    return key.select("id", N.chinese_number(text).alias("out"))


@query(
    NAMES
    + """SELECT id, coalesce(nullif(regexp_extract(name, '(?:特控|上线|重本|一本|高优|本科)率[^0-9]{0,6}?(\\d+(?:\\.\\d+)?)\\s*%', 1), '')::DOUBLE,
 nullif(regexp_extract(name, '(?:超|达|约|近)\\s*(\\d+(?:\\.\\d+)?)\\s*%', 1), '')::DOUBLE) AS out FROM names"""
)
def percentages(spark, sf_dir):
    return _each(spark, sf_dir, N.percentage(F.col("name")))


@query(_sql("try_cast(nullif(regexp_extract(name, '\\d+'), '') AS INTEGER)"))
def first_integers(spark, sf_dir):
    return _each(spark, sf_dir, N.first_integer(F.col("name")))


@query("SELECT l_orderkey AS id, l_linenumber AS line, try_cast(CASE WHEN v NOT IN ('', '--', '—', 'None') THEN v END AS INTEGER) AS out, try_cast(CASE WHEN regexp_matches(trim(v), '^\\d+$') THEN trim(v) END AS INTEGER) AS digits FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN '--' WHEN 'N' THEN ' ' || l_linenumber::VARCHAR ELSE (l_orderkey % 1000)::VARCHAR END AS v FROM lineitem)")
def dashes(spark, sf_dir):
    v = F.when(F.col("l_returnflag") == "A", "--").when(F.col("l_returnflag") == "N", F.concat(F.lit(" "), F.col("l_linenumber").cast("string"))).otherwise((F.col("l_orderkey") % 1000).cast("string"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), N.dash_as_null(v).alias("out"), N.digits_only(v).alias("digits"))


@query(_sql("CASE WHEN trim(regexp_replace(name, '^2026年', '')) LIKE '%）' THEN regexp_replace(trim(regexp_replace(name, '^2026年', '')), '（[^（）]*）$', '') ELSE regexp_replace(trim(regexp_replace(name, '^2026年', '')), '(.)（[^（]*$', '\\1') END"))
def strip_year_project(spark, sf_dir):
    return _each(spark, sf_dir, N.strip_project(N.strip_year(F.col("name"))))


@query(_sql("regexp_replace(regexp_replace(name, '见?说明1([^\\d]|$)', '甲\\1', 'g'), '见?说明2([^\\d]|$)', '乙\\1', 'g')"))
def references(spark, sf_dir):
    return _each(spark, sf_dir, N.expand_references(F.col("name"), {1: "甲", 2: "乙"}))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '电脑派位' ELSE '电脑派位第' || p_size::VARCHAR || '组' END AS out FROM part")
def group_labels(spark, sf_dir):
    note = F.when(F.col("p_size") % 3 == 0, "番禺 电脑派位").when(F.col("p_size") % 3 == 1, F.concat(F.lit("第 "), F.col("p_size").cast("string"), F.lit("组"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("组电脑派位")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.group_label(note).alias("out"))


_TEXTS = ["天河区对口直升", "海珠区对口直升", "第1组电脑派位", "不参加电脑派位，内部直升", "天河区附件10电脑派位", "市桥城区 电脑抽签", "待核", "九年制学校 单校划片"]
_FOUND = ["single_zone", "zhi_sheng", "group_paidui", "zhi_sheng", "min_zi_zhu", "group_paidui,single_chouqian", "", "zhi_sheng,single_zone"]


@query("SELECT p_partkey AS id, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_FOUND)) + " END AS out FROM part")
def mechanism_enum(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(N.mechanisms(text), ",").alias("out"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'gold' WHEN o_orderpriority LIKE '2%' THEN 'silver' WHEN o_orderpriority LIKE '3%' THEN 'bronze' END AS out FROM orders")
def medals(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), N.medal(F.col("o_orderpriority"), {"gold": ["^1"], "silver": ["^2"], "bronze": ["^3"]}).alias("out"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '未匹配:' || p_brand ELSE '' END AS gap, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand || '；' || p_type END AS note FROM part")
def remarks(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("未匹配:"), "p_brand", F.lit("；"), "p_type")).otherwise(F.concat("p_brand", F.lit("；"), "p_type"))
    out = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.split_remark(text, "(未匹配:[^;；]*)").alias("r"))
    return out.select("id", "r.gap", "r.note")


@query("SELECT p_partkey AS id, 'gz-' || (440100 + p_size)::VARCHAR || '-' || substr(sha1((440100 + p_size)::VARCHAR || '|' || p_name), 1, 8) AS key, (440100 + p_size)::VARCHAR AS area FROM part")
def surrogate_keys(spark, sf_dir):
    area = (F.col("p_size") + 440100).cast("string")
    out = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.surrogate_key(area, area, F.col("p_name")).alias("key"))
    return out.withColumn("area", N.key_area(F.col("key")))


@query("SELECT a.p_partkey AS id, (CASE WHEN abs(length(a.p_brand) - length(a.p_type)) > 1 THEN 9 ELSE levenshtein(a.p_brand, a.p_type) END)::INT AS out FROM part a")
def edit_distance(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.near_distance(F.col("p_brand"), F.col("p_type")).cast("int").alias("out"))


@query("SELECT page_id AS id, CASE WHEN contains(url, 'https') AND contains(url, '1') THEN 'secure one' WHEN contains(url, '2') THEN 'two' ELSE 'other' END AS out FROM pages")
def source_labels(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), N.source_label(F.col("url"), [(["https", "1"], "secure one"), (["2"], "two")], "other").alias("out"))


@query("SELECT doc_id AS id, CASE WHEN w IS NULL THEN '未查到' WHEN len(w) > 4 THEN array_to_string(w[1:4], '、') || '等' ELSE array_to_string(w, '、') END AS out FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def brief_lists(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), N.brief_list(F.split("text", " ")).alias("out"))


@query("SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'none' END AS one, array_to_string(list_filter(list_distinct_in_order, lambda x: x IN ('click', 'view', 'x')), ',') AS many FROM (SELECT *, CASE WHEN event_type = 'x' THEN ['x'] ELSE [event_type, 'x'] END AS list_distinct_in_order FROM events)")
def url_state(spark, sf_dir):
    state = F.concat(F.col("event_type"), F.lit(",,x,"), F.col("event_type"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), N.query_scalar(F.col("event_type"), ["click", "view"], "none").alias("one"), F.array_join(N.query_set(state, ["click", "view", "x"]), ",").alias("many"))


@query("SELECT p_partkey AS id, p_brand || '（' || p_type || '）' AS out FROM part")
def suffix_repair(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("（"), "p_type", F.lit("，“领军龙”学校）"))).otherwise(F.concat("p_brand", F.lit("（"), "p_type", F.lit("）（\"领军龙\"学校）")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.repair_suffix(text).alias("out"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '传承项目：' || p_brand || '；艺术项目：' || p_type END AS out FROM part")
def labelled_parts(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("采集; 传承项目: "), "p_brand", F.lit("；艺术项目:"), "p_type", F.lit("; 传承项目:"))).otherwise("无")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.labelled_segments(text, ["传承项目", "艺术项目"]).alias("out"))


@query("SELECT p_partkey AS id, unnest([p_brand, p_type, '甲校']) AS item FROM part")
def phrase_items(spark, sf_dir):
    text = F.concat(F.lit("另有九年一贯制学校（"), "p_brand", F.lit("、"), "p_type", F.lit("和甲校）。"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(N.phrase_list(text, "九年一贯制学校")).alias("item"))


@query("SELECT p_partkey AS id, unnest([p_brand || '小学（东、西校区）', p_type || '学校']) AS item FROM part")
def scope_items(spark, sf_dir):
    text = F.concat("p_brand", F.lit("小学（东、西校区）、"), "p_type", F.lit("学校（地段生，含户籍生）；某某路以东；面向居住人员子女学校"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(N.scope_parts(text, ["地段生", "户籍生"], ["小学", "学校", "校区"], ["面向", "居住"])).alias("item"))


@query(_sql("regexp_replace(name, '^(.+?)(?:\\((?:{0})\\)|（(?:{0})）|{0}|[（(])+$', '\\1')".format(_GEN.replace("'", "").replace(",", "|"))))
def stripped_generic(spark, sf_dir):
    return _each(spark, sf_dir, N.strip_generic(F.col("name")))


@query()
def folded_unicode(spark, sf_dir):
    """N11; DuckDB has no NFKC."""
    return _each(spark, sf_dir, N.fold_unicode(F.col("name")))


@query()
def variants_of_names(spark, sf_dir):
    return _each(spark, sf_dir, F.array_join(N.name_variants(F.col("name")), "|"))


@query()
def repaired_names(spark, sf_dir):
    return _each(spark, sf_dir, N.repair_name(F.concat(F.lit("市"), F.substring("name", 1, 2), F.lit("\n"), F.substring("name", 3, 10_000))))


@query()
def fuzzy_fixes(spark, sf_dir):
    """Names with one character misread, put right by the list of all names."""
    names = _names(spark, sf_dir).filter("name is not null")
    broken = names.withColumn("read", F.concat(F.substring("name", 1, 3), F.lit("误"), F.substring("name", 5, 10_000)))
    return N.fuzzy_fix(broken, "read", names, "name", "id").select("id", "read", "fixed", "rule")


@query("SELECT p_partkey AS id, round_even(p_retailprice / 8, 1) AS one, round_even(p_retailprice / 8, 4) AS four FROM part")
def rounded_half_even(spark, sf_dir):
    price = (F.col("p_retailprice") / 8).cast("decimal(18,6)")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geo.round_half_even(price, 1).cast("double").alias("one"), geo.round_half_even(price, 4).cast("double").alias("four"))


# Places by key; no table has coordinates of its own.
PLACE = "113 + ({0} * 37 % 1000) / 1000.0 AS lng, 23 + ({0} * 91 % 1000) / 1000.0 AS lat"
_HAV = "pow(sin(radians(lat - 23.1) / 2), 2) + cos(radians(23.1)) * cos(radians(lat)) * pow(sin(radians(lng - 113.3) / 2), 2)"
_PLACED = f"WITH c AS (SELECT c_custkey AS id, {PLACE.format('c_custkey')} FROM customer) "


def placed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("lng", 113 + (F.col(key) * 37 % 1000) / 1000.0).withColumn("lat", 23 + (F.col(key) * 91 % 1000) / 1000.0)


@query(_PLACED + f"SELECT id, round(2 * 6371000 * asin(sqrt({_HAV})), 3) AS metres, round(2 * 6371 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))), 5) AS km, round(sqrt(pow(lng - 113.3, 2) + pow(lat - 23.1, 2)) * 97, 5) AS planar, lng BETWEEN 113.2 AND 113.6 AND lat BETWEEN 23.0 AND 23.5 AS inside, floor(lng * 100 + 0.5) / 100 AS rounded FROM c")
def distances(spark, sf_dir):
    c = placed(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")
    lng, lat, x, y = F.col("lng"), F.col("lat"), F.lit(113.3), F.lit(23.1)
    return c.select(
        "id", F.round(geo.metres(x, y, lng, lat), 3).alias("metres"), F.round(geo.kilometres(x, y, lng, lat), 5).alias("km"), F.round(geo.planar_km(x, y, lng, lat), 5).alias("planar"),
        geo.in_box(lng, lat, 113.2, 23.0, 113.6, 23.5).alias("inside"), geo.round_half_up(lng, 2).alias("rounded"),
    )
