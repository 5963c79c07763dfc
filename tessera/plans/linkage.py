"""The linkage view (G16) for both sides of a transition, and a place's card (G18), as tables for all entities at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import names as N
from tessera.operators.common import small

#: How ids begin, how many rows a view shows, notes of projects and the keys they stand for, texts of a card.
ID_PREFIX = "gz-"
MOST_COVERED, MOST_AREA_COVERED = 30, 50
PROJECT_NOTES = (("体育后备人才", "reserve"), ("领军龙", "lingjun"))
STAGES = {"primary": "小学", "middle": "初中", "high": "高中"}
DEPARTMENTS = {"primary": "小学部", "middle": "初中部", "high": "高中部"}
HIGH_NOTE = "口径：录取线为官方发布（公办户籍生 / 民办最低分）；特控率/高分段为喜报或网传数据。完整出口数据见详情页。"
NO_RECORD_NOTE = "该点位暂未匹配到高中分类（可能为未收录学校）。"
NO_FEEDERS = "无公办对口名单（民办校以摇号/直升为准）"
FEEDERS_SHOWN = 3


def _last(df: DataFrame, *keys: str) -> DataFrame:
    """The last row by ord of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.filter(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("_r")).select(*keys, "_r.*")


def middle_linkage(quota: DataFrame, batch: DataFrame, district: DataFrame, campuses: DataFrame, entities: DataFrame, places: DataFrame) -> DataFrame:
    """(middle, part, place, key, name, school, poi, n, score): the places a middle school's pupils can go to.

    ``quota`` has middle, key and n, where the key is a campus's id, or the name of a campus without one; ``batch``
    middle, key, score and ord; ``district`` middle, key, n and ord - keys are ids or names. ``campuses`` has id (null
    where there is no entity), name, school and ord; ``entities`` id and name; ``places`` name and poi, the entity that
    a name resolves to.

    Part ``batch`` has quotas above 0 and the least scores of the listed campuses, as one row a campus; a campus
    without an entity never leads to one. Part ``district`` has the district's quotas with the score of the same key
    among the batch rows of other schools. Rows are placed by n from large to small, null as 0, then as given.
    """
    who = small(entities.select(F.col("id").alias("_id"), F.col("name").alias("_known")))
    lead = lambda key, out: small(places.select(F.col("name").alias(key), F.col("poi").alias(out)))
    sites = campuses.join(who, F.col("id") == F.col("_id"), "left").select(F.coalesce("id", "name").alias("key"), F.coalesce("_known", "name").alias("q_name"), F.col("school").alias("q_school"), F.col("_known").alias("q_poi"), F.col("ord").alias("q_ord"))
    quotas = quota.filter("n > 0").join(small(sites), "key")
    b = batch.join(who, F.col("key") == F.col("_id"), "left").withColumn("nm", F.coalesce("_known", "key"))
    for k, (by, of) in enumerate((("key", "name"), ("nm", "name"), ("key", "id"))):
        found = _last(campuses.select(F.col(of).alias(by), F.struct("id", "school").alias(f"_c{k}"), "ord"), by).drop("ord")
        b = b.join(small(found), by, "left")
    b = b.withColumn("_c", F.coalesce("_c0", "_c1", "_c2")).withColumn("_site", F.col("_c.school"))
    b = b.join(lead("nm", "_p_nm"), "nm", "left").join(lead("_site", "_p_site"), "_site", "left").join(lead("key", "_p_key"), "key", "left")
    listed = F.col("_c").isNotNull()
    b = b.select(
        "middle", F.when(F.startswith("key", F.lit(ID_PREFIX)), F.col("key")).otherwise(F.coalesce("_c.id", "key")).alias("key"), listed.alias("listed"), F.col("nm").alias("b_name"), F.coalesce("_c.school", "nm").alias("b_school"),
        F.when(listed, F.when(F.col("_c.id").isNotNull(), F.coalesce("_p_nm", "_p_site"))).otherwise(F.coalesce("_known", "_p_key")).alias("b_poi"), "score", "ord",
    )
    # a campus that two keys lead to keeps the last one's row
    own, other = (_last(b.filter(c).drop("listed"), "middle", "key") for c in ("listed", "not listed"))
    merged = quotas.join(own.withColumnRenamed("ord", "b_ord"), ["middle", "key"], "full_outer").select(
        "middle", F.lit("batch").alias("part"), "key", F.coalesce("b_name", "q_name", "key").alias("name"), F.coalesce("b_school", "q_school").alias("school"), F.coalesce("b_poi", "q_poi").alias("poi"), "n", "score",
        F.struct(F.coalesce("q_ord", F.lit(1 << 40)).cast("long").alias("a"), F.col("b_ord").cast("long").alias("b")).alias("_o"),
    )
    d = district.join(who, F.col("key") == F.col("_id"), "left").join(lead("key", "_p_key"), "key", "left").join(other.drop("ord"), ["middle", "key"], "left").select(
        "middle", F.lit("district").alias("part"), "key", F.coalesce("b_name", "_known", "key").alias("name"), F.lit(None).cast("string").alias("school"), F.coalesce("b_poi", "_known", "_p_key").alias("poi"), "n", "score",
        F.struct(F.lit(0).cast("long").alias("a"), F.col("ord").cast("long").alias("b")).alias("_o"),
    )
    place = F.row_number().over(W.partitionBy("middle", "part").orderBy(F.coalesce("n", F.lit(0)).desc(), "_o", "key"))
    return merged.unionByName(d).withColumn("place", place).drop("_o")


def high_linkage(targets: DataFrame, campuses: DataFrame, entities: DataFrame, coverage: DataFrame, area_coverage: DataFrame) -> DataFrame:
    """(qid, part, place, school, school_id, n, areas): the schools whose pupils come to each target (qid, name).

    A target is the campuses whose entity has its name up to the width of brackets, else those of its school by plain
    name. Part ``quota`` sums ``coverage`` (campus id, school, school_id, n, area, ord) over them by school, with the
    distinct areas and the first id, the 30 largest; part ``district`` has the 50 largest of ``area_coverage`` (target's
    name, school, school_id, n, ord). Campuses without an entity don't count.
    """
    of_id = campuses.filter("id is not null").join(small(entities.select("id", F.col("name").alias("e_name"))), "id", "left")
    exact = targets.join(of_id.select("id", N.unify_brackets(F.col("e_name")).alias("_k")), N.unify_brackets(F.col("name")) == F.col("_k")).select("qid", "id")
    rest = targets.join(exact.select("qid").distinct(), "qid", "left_anti")
    forms = lambda c: F.explode(F.array_distinct(F.array(F.concat(F.lit("0"), N.without_brackets(F.col(c))), F.concat(F.lit("1"), F.col(c))))).alias("_k")
    loose = rest.select("qid", forms("name")).join(of_id.select("id", forms("school")), "_k").select("qid", "id").distinct()
    hits = exact.distinct().union(loose).join(coverage.withColumnRenamed("campus", "id"), "id")
    summed = hits.groupBy("qid", "school").agg(F.min_by("school_id", F.when(F.col("school_id").isNotNull(), F.col("ord"))).alias("school_id"), F.sum("n").alias("n"), F.array_sort(F.collect_set("area")).alias("areas"), F.min("ord").alias("ord"))
    near = targets.join(area_coverage.withColumnRenamed("target", "name"), "name").select("qid", "school", "school_id", F.col("n").cast("long").alias("n"), F.array().cast("array<string>").alias("areas"), "ord")
    every = summed.withColumn("part", F.lit("quota")).unionByName(near.withColumn("part", F.lit("district")))
    place = F.row_number().over(W.partitionBy("qid", "part").orderBy(F.desc("n"), "ord", "school"))
    most = F.when(F.col("part") == "quota", MOST_COVERED).otherwise(MOST_AREA_COVERED)
    return every.withColumn("place", place).filter(F.col("place") <= most).drop("ord")


def plan_notes(notes: str | Column) -> Column:
    """The keys of what an array of project notes speaks of, in a fixed order; empty for null."""
    said = lambda text: F.coalesce(F.exists(notes, lambda n: F.coalesce(n.contains(text), F.lit(False))), F.lit(False))
    return F.array_compact(F.array(*[F.when(said(text), key) for text, key in PROJECT_NOTES]))


def _uri(c: Column) -> Column:
    """A part of an address: percent-encoded but for letters, digits and -_.!~*'()."""
    t = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return t


def place_card(points: DataFrame, shown: Sequence[str] = ("name", "rows", "note", "links")) -> DataFrame:
    """A place's card: rows of (label, value, strong), a note and links of (text, to).

    ``points`` has name, school_id, area_name, stages (array in order), main_stage, ids (map of stage to id), and of each
    stage's facts: has_record, scores (array of label and value), top_rate and high_share; classes, zone and route;
    feeders (array of names). A missing or empty fact has no row, except that a middle school without feeders says so
    and an unknown area is a dash. A high school with a record shows its figures, any other place its stages and area.
    """
    def row(label: str, value: Column, strong: bool = False, when: Column | None = None) -> Column:
        cell = F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"), F.lit(strong).alias("strong"))
        return F.when(value.isNotNull() & (value.cast("string") != "") & (F.lit(True) if when is None else when), cell)

    labels = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    high = F.coalesce(F.col("main_stage") == "high", F.lit(False))
    record = high & F.coalesce("has_record", F.lit(False))
    has = lambda stage: ~high & F.array_contains("stages", stage)
    feeders = F.coalesce("feeders", F.array().cast("array<string>"))
    preview = F.concat(F.array_join(F.slice(feeders, 1, FEEDERS_SHOWN), "、"), F.when(F.size(feeders) > FEEDERS_SHOWN, F.concat(F.lit(" 等 "), F.size(feeders).cast("string"), F.lit(" 所"))).otherwise(""))
    plain = F.array(
        row("学部", F.array_join(F.transform("stages", lambda s: F.try_element_at(labels(STAGES), s)), "、")), row("所在区", F.coalesce(F.nullif(F.col("area_name"), F.lit("")), F.lit("—"))),
        row("2026班数", F.concat(F.col("classes").cast("string"), F.lit(" 个班")), True, has("primary")), row("招生地段", F.col("zone"), False, has("primary")), row("升学路线", F.col("route"), False, has("primary")),
        row("生源小学", preview, True, has("middle") & (F.size(feeders) > 0)), row("生源小学", F.lit(NO_FEEDERS), False, has("middle") & (F.size(feeders) == 0)),
    )
    scores = F.transform("scores", lambda s: F.struct(s["label"].alias("label"), s["value"].cast("string").alias("value"), F.lit(False).alias("strong")))
    figures = F.concat(F.coalesce(scores, F.array().cast("array<struct<label:string,value:string,strong:boolean>>")), F.array(row("特控线上线率 2026", F.col("top_rate")), row("高分段 2026", F.col("high_share"))))
    note = F.when(record, HIGH_NOTE).when(high, NO_RECORD_NOTE)

    def address(stage: Column | None, ident: Column) -> Column:
        parts = F.array_compact(F.array(*([] if stage is None else [F.concat(F.lit("stage="), stage)]), F.concat(F.lit("id="), _uri(F.nullif(ident, F.lit(""))))))
        return F.concat(F.lit("/school/"), _uri(F.col("name")), F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))

    link = lambda text, to: F.struct(text.alias("text"), to.alias("to"))
    several = F.transform("stages", lambda s: link(F.concat(F.lit("查看"), F.try_element_at(labels(DEPARTMENTS), s), F.lit("详情 →")), address(s, F.try_element_at(F.col("ids"), s))))
    one = F.array(link(F.lit("查看学校详情 →"), address(F.col("main_stage"), F.try_element_at(F.col("ids"), F.col("main_stage")))))
    out = points.withColumn("rows", F.array_compact(F.when(record, figures).otherwise(plain))).withColumn("note", note).withColumn("links", F.when(F.size("stages") > 1, several).otherwise(one))
    return out.select(*[c for c in points.columns if c not in shown], *shown)
