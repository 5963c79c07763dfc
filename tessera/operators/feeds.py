"""Builds of feeder and plan records from official lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import names as N
from tessera.operators.campuses import campuses
from tessera.operators.common import ASKED_BLOCK, FOUND_BLOCK, first_by, in_blocks, materialised, pairs_of_blocks, small
from tessera.operators.resolve import FAR_WORDS

#: What parts a line's names, marks of a campus in an entity's name, labels that mean the legal entity itself.
NAME_BREAKS = "[、，,;；\n]"
CAMPUS_MARKS = ("校区", "分校", "教学点", "分教点", "分部", "本部")
MAIN_LABELS = ("南校区", "本部", "校本部", "总校区", "主校区", "正校")
LATER_SUFFIX = "（(初中校区|初中部|校本部)）$"


def campus_lines(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(row, id, pos, name): the names of each line "campus：a、b" of a record's scope, with the campus's entity.

    ``records`` has row, ids (in order) and scope; ``entities`` id and name. A label that speaks of a campus means the
    first of the record's entities whose name without brackets holds it; a label for the main site that none holds, the
    first without a campus in its name. Lines of other labels, or that lead to no entity, give no rows.
    """
    lines = records.select("row", F.posexplode(F.split("scope", "\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    parsed = r"^(.+?)[：:](.+)$"
    lines = lines.filter(F.col("line").rlike(parsed)).select("row", "line_no", F.trim(F.regexp_extract("line", parsed, 1)).alias("label"), F.regexp_extract("line", parsed, 2).alias("rest")).filter(F.contains("label", F.lit("校区")))
    sites = records.select("row", F.posexplode("ids").alias("place", "id")).join(small(entities.select("id", "name")), "id", "left")
    sites = sites.withColumn("flat", F.translate(F.coalesce("name", F.lit("")), "（）()", "")).withColumn("legal", ~F.coalesce(F.col("name").rlike("|".join(CAMPUS_MARKS)), F.lit(False)))
    pairs = lines.select("row", "line_no", "label").join(sites, "row")
    rank = F.when(F.contains("flat", "label"), 0).when(F.col("legal") & F.col("label").isin(*MAIN_LABELS), 1)
    hits = pairs.withColumn("rank", rank).filter("rank is not null").groupBy("row", "line_no").agg(F.min_by("id", F.struct("rank", "place")).alias("id"))
    parts = F.filter(F.transform(F.split("rest", NAME_BREAKS), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    every = lines.join(hits, ["row", "line_no"]).select("row", "id", "line_no", F.posexplode(parts).alias("at", "name"))
    return every.select("row", "id", (F.row_number().over(W.partitionBy("row", "id").orderBy("line_no", "at")) - 1).alias("pos"), "name")


def group_plans(groups: DataFrame, plan: DataFrame, grouped: str, alone: str) -> DataFrame:
    """A row for each member of each group with the array of all and the member's plan; then the plan's rows of no group.

    ``groups`` has members (an array) and any other columns; ``plan`` name (unique) and plan. ``mechanism`` is
    ``grouped`` or ``alone``. Names are compared trimmed; a member of several groups has a row for each.
    """
    rows = groups.withColumn("name", F.explode("members")).withColumn("_k", F.trim("name"))
    plans = plan.select(F.trim("name").alias("_k"), "plan")
    out = rows.join(small(plans), "_k", "left").withColumn("mechanism", F.lit(grouped))
    rest = plans.join(rows.select("_k").distinct(), "_k", "left_anti").withColumn("name", F.col("_k")).withColumn("mechanism", F.lit(alone))
    return out.unionByName(rest, allowMissingColumns=True).drop("_k")


def year_rows(queries: DataFrame, rows: DataFrame, equivalents: DataFrame, resolved: DataFrame) -> DataFrame:
    """A row for each (qid, row): the rows of another year's table for the first spelling of a name that has any.

    ``queries`` has qid and name; ``rows`` row and name; ``equivalents`` name, other and ord; ``resolved`` qid and name,
    the names and aliases of the entities that a query resolves to. Spellings: the name, its equivalents in order, the
    name without a later year's suffix - each against the rows' names with and without that suffix - then the resolved
    names against the rows' own. Compared by N2; null and empty names have no rows. The spelling that counts is found
    before any row is joined, once for each name, and queries and rows of the same spellings meet in blocks, so that the
    pairs are made last and are not shuffled.
    """
    norm = N.strict_norm_spaces
    bare = lambda c: norm(F.regexp_replace(c, LATER_SUFFIX, ""))
    asked = queries.filter("name <> ''").select("qid", "name")
    once = asked.select("name").distinct()
    own = once.select("name", F.lit(0).alias("tier"), norm(F.col("name")).alias("key"))
    other = once.join(equivalents, "name").select("name", (F.col("ord").cast("long") + 1).alias("tier"), norm(F.col("other")).alias("key"))
    most, last = (1 << 62) - 1, 1 << 62
    cut = once.select("name", F.lit(most).alias("tier"), bare(F.col("name")).alias("key"))
    found = resolved.select("qid", F.lit(last).alias("tier"), norm(F.col("name")).alias("key"))
    both = rows.select("row", F.explode(F.array_distinct(F.array(norm(F.col("name")), bare(F.col("name"))))).alias("key")).withColumn("whole", F.lit(False))
    keyed = both.unionByName(rows.select("row", norm(F.col("name")).alias("key")).withColumn("whole", F.lit(True))).distinct()

    def first_keys(spelt: DataFrame, of: str) -> DataFrame:
        spelt = spelt.filter("key <> ''").withColumn("whole", F.col("tier") == last)
        known = spelt.join(keyed.select("key", "whole").distinct(), ["key", "whole"], "left_semi").groupBy(of, "tier").agg(F.collect_set(F.struct("key", "whole")).alias("keys"))
        return known.groupBy(of).agg(F.min(F.col("tier")).alias("tier"), F.min_by("keys", "tier").alias("keys"))

    of_names = first_keys(reduce(DataFrame.unionByName, [own, other, cut]), "name")
    every = asked.join(of_names, "name").select("qid", "tier", "keys").unionByName(first_keys(found, "qid"))
    every = every.groupBy("qid").agg(F.min("tier").alias("tier"), F.collect_list(F.struct("tier", "keys")).alias("all"))
    best = every.select("qid", F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("all", lambda s: s["tier"] == F.col("tier")), lambda s: s["keys"])))).alias("keys"))
    blocks = materialised(in_blocks(best, ["keys"], ["qid"], "qid", ASKED_BLOCK, "_asked"))
    hits = blocks.select("keys").distinct().select("keys", F.size("keys").alias("n"), F.inline("keys")).join(keyed, ["key", "whole"])
    # only several keys can lead to a row twice
    hits = hits.filter("n = 1").select("keys", "row").union(hits.filter("n > 1").select("keys", "row").distinct())
    return pairs_of_blocks(blocks, in_blocks(hits, ["keys"], ["row"], "row", FOUND_BLOCK, "_found"), "keys", ["qid"], "row").select("qid", "row")


def district_feeds(official: DataFrame, groups: DataFrame, points: DataFrame, reasons: DataFrame, entities: DataFrame, overrides: DataFrame, areas: Mapping[str, str], far: Sequence[str] = FAR_WORDS) -> DataFrame:
    """The feed records of districts: (status, area, id, name, group_no, feed, direct, gap, official).

    ``official`` has ord (unique), name, area, group_no, direct, direct_joins and refused; ``groups`` area, group_no and
    feed; ``points`` id, name and area; ``reasons`` area, name and reason. ``entities``, ``overrides`` and ``areas`` are
    those of :func:`campuses`, which leads each official name to all its primary campuses.

    - ``record``: each id once, by the first official name that reaches it, with its group's feed; a direct target that
      joins stands before the group's others unless it is one of them, and without a group it is the feed.
    - ``gap``: a point of an official area that no record covers, with the reason that is stated for its name.
    - ``missing``: such a point without a reason.
    - ``unresolved``: an official name that is refused or leads nowhere.
    """
    asked = materialised(official.withColumn("refused", F.coalesce("refused", F.lit(False))))
    hits = campuses(asked.filter("not refused").select(F.col("ord").alias("qid"), "name", "area", F.lit("primary").alias("stage")), entities, overrides, areas, far).select(F.col("qid").alias("ord"), "id")
    hits = materialised(hits)
    none = F.array().cast("array<string>")
    rows = first_by(hits.join(asked.withColumnRenamed("name", "official"), "ord"), "id", ["ord"]).join(small(groups), ["area", "group_no"], "left")
    known = F.coalesce("feed", none)
    joins = F.coalesce("direct_joins", F.lit(False)) & ~F.array_contains(known, F.col("direct"))
    feed = F.when(F.col("direct").isNull(), known).when(F.size(known) == 0, F.array("direct")).when(joins, F.concat(F.array("direct"), known)).otherwise(known)
    named = entities.groupBy("id").agg(F.min_by("name", "ord").alias("name"))
    records = rows.withColumn("feed", feed).join(named, "id").select(F.lit("record").alias("status"), "area", "id", "name", "group_no", "feed", "direct", F.lit(None).cast("string").alias("gap"), "official")
    bare = points.join(small(asked.select("area").distinct()), "area", "left_semi").join(rows.select("id"), "id", "left_anti").join(small(reasons.select("area", "name", F.col("reason").alias("gap"))), ["area", "name"], "left")
    bare = bare.select(F.when(F.col("gap").isNotNull(), "gap").otherwise("missing").alias("status"), "area", "id", "name", none.alias("feed"), "gap")
    lost = asked.join(hits.select("ord").distinct(), "ord", "left_anti").select(F.lit("unresolved").alias("status"), "area", F.col("name").alias("official"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [records, bare, lost])
