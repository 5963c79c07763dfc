"""The entity table (G22), built from points of interest and tables of what is known about them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import names as N
from tessera.operators.common import first_by, materialised, small

#: The nature of the listed entities, and the word that follows a district's name.
PRIVATE = "民办"
DISTRICT = "区"


def entity_table(points: DataFrame, denied: DataFrame, renamed: DataFrame, restaged: DataFrame, attached: DataFrame, kept: DataFrame, private: DataFrame, areas: Mapping[str, str]) -> DataFrame:
    """(id, stage, name, area, aliases, nature, ord): one entity for each stage and id.

    ``points`` has ord (unique), name, area, stage and id (or null); ``denied`` name; ``renamed`` name and fixed;
    ``restaged`` name, area and right; ``attached`` ord (unique), stage, name, alias and force; ``kept`` id and alias;
    ``private`` id. ``areas`` leads from an area to its district's word.

    - Denied points go, names and stages are put right, and a point without an id gets the key of its area and name.
    - Of several points of a stage and id the first stands; the names of the others are aliases.
    - A name with brackets has its core as an alias, if no other point of the area and stage has that core.
    - An attached alias goes to the last entity of its stage and name, else to the first of any stage. Unless it is
      forced, it must be no other entity's name in that area, nor attached there to another one before.
    - Aliases that begin with the own district go, if the district goes when names are compared (N6), they are not to be
      kept, and no other entity's name or alias equals what is left.
    - An alias is never the entity's own normalised name (N2); aliases are ordered from long to short, then by text.
    """
    named = points.join(small(denied.select("name").distinct()), "name", "left_anti").join(small(renamed.dropDuplicates(["name"])), "name", "left").join(small(restaged.dropDuplicates(["name", "area"])), ["name", "area"], "left")
    rows = named.select("ord", F.coalesce("fixed", "name").alias("name"), "area", F.coalesce("right", "stage").alias("stage"), "id")
    rows = rows.withColumn("norm", N.strict_norm_spaces(F.col("name")))
    rows = rows.withColumn("id", F.coalesce("id", N.surrogate_key(F.col("area"), F.col("area"), F.col("norm")))).withColumn("core", N.strict_norm_spaces(N.core_campus_name(F.col("name"))))
    rows = materialised(rows)
    built = materialised(first_by(rows, ["stage", "id"], ["ord"]))
    own = built.select("stage", "id", F.col("norm").alias("own"))
    other = rows.select("stage", "id", F.col("norm").alias("alias"))
    lone = rows.filter(F.col("name").rlike("[(（]") & (F.col("core") != "")).groupBy("stage", "area", "core").agg(F.count("*").alias("n")).filter("n = 1")
    cores = built.filter(F.col("name").rlike("[(（]")).join(lone, ["stage", "area", "core"], "left_semi").select("stage", "id", F.col("core").alias("alias"))
    # an alias's entity: of the wanted stage the last, of the others the first
    wanted = attached.select(F.col("ord").alias("at"), F.col("stage").alias("asked"), N.strict_norm_spaces(F.col("name")).alias("norm"), N.strict_norm_spaces(F.col("alias")).alias("alias"), F.coalesce("force", F.lit(False)).alias("force"))
    found = wanted.join(built.select("stage", "id", "area", "norm", "ord"), "norm").filter("alias <> ''")
    best = F.row_number().over(W.partitionBy("at").orderBy(F.desc(F.col("stage").eqNullSafe(F.col("asked"))), F.when(F.col("stage").eqNullSafe(F.col("asked")), -F.col("ord")).otherwise(F.col("ord"))))
    found = found.withColumn("_r", best).filter("_r = 1")
    holders = built.groupBy("area", F.col("norm").alias("alias")).agg(F.min_by("id", "ord").alias("holder"))
    earlier = F.first("id").over(W.partitionBy("area", "alias").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    given = found.withColumn("earlier", earlier).join(holders, ["area", "alias"], "left").filter(F.col("force") | (F.coalesce("holder", "earlier") == F.col("id"))).select("stage", "id", "alias")
    every = other.union(cores).union(given).unionByName(kept.join(built.select("stage", "id"), "id").select("stage", "id", "alias")).distinct()
    every = materialised(every.join(own, ["stage", "id"]).filter("alias <> '' and alias <> own").select("stage", "id", "alias"))
    # slimming
    keys = built.select("id", N.match_norm(F.col("name")).alias("key")).union(every.select("id", N.match_norm(F.col("alias")).alias("key"))).filter("key <> ''")
    shared = keys.groupBy("key").agg(F.countDistinct("id").alias("owners")).filter("owners > 1").select("key")
    words = F.create_map(*[F.lit(x) for kv in areas.items() for x in kv]) if areas else F.create_map().cast("map<string,string>")
    marked = every.join(built.select("stage", "id", "area"), ["stage", "id"]).withColumn("key", N.match_norm(F.col("alias")))
    own_area = F.startswith("alias", F.concat(F.try_element_at(words, F.col("area")), F.lit(DISTRICT)))
    goes = F.coalesce(own_area, F.lit(False)) & ~F.col("key").rlike(f"^({'|'.join(N.DISTRICTS)})")
    marked = marked.join(shared.withColumn("both", F.lit(True)), "key", "left").join(kept.select("id", "alias").distinct().withColumn("stays", F.lit(True)), ["id", "alias"], "left")
    slim = marked.filter(~goes | F.coalesce("both", "stays", F.lit(False)))
    lists = slim.groupBy("stage", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("l"), "alias"))), lambda a: a["alias"]).alias("aliases"))
    nature = private.select("id").distinct().withColumn("nature", F.lit(PRIVATE))
    out = built.join(lists, ["stage", "id"], "left").join(small(nature), "id", "left")
    return out.select("id", "stage", "name", "area", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "nature", "ord")
