"""Arrays, maps, nested documents and feeder relations; relations are edge tables, nested only for output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.common import asked_once, cols, first_by, small, to_all
from tessera.operators.joins import index_ids


def flat_members(maps: str) -> Column:
    """G1: the members of all arrays of a map, without repeats."""
    return F.array_distinct(F.flatten(F.map_values(maps)))


def named_members(df: DataFrame, key: str, maps: str, names: DataFrame, identity: str, name: str) -> DataFrame:
    """A map of id arrays as a map of name arrays, in the ids' order; unknown ids go."""
    edges = df.select(key, F.explode(maps).alias("k", "ids")).select(key, "k", F.posexplode("ids").alias("pos", identity))
    joined = edges.join(small(names.select(identity, name)), identity)
    per = joined.groupBy(key, "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", name))), lambda x: x[name]).alias("v"))
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(maps))


def route_groups(edges: DataFrame, key: str, kind: str, target: str, direct: str, priority: Mapping[str, int], unknown: int = 9) -> DataFrame:
    """Per key and kind the targets other than the direct one, with the kind's place by priority."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col(kind)), F.lit(unknown))
    rows = edges.filter(~F.col(target).eqNullSafe(F.col(direct))).groupBy(key, kind).agg(F.array_sort(F.collect_set(target)).alias("targets"))
    return rows.withColumn("priority", rank).withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("priority", kind)))


def reverse_edges(df: DataFrame, sources: str, targets: str, kind: str) -> DataFrame:
    """A row's sources x targets the other way round: per target and kind the distinct sources."""
    edges = df.select(F.explode(sources).alias("source"), targets, kind).select("source", F.explode(targets).alias("target"), kind)
    return edges.groupBy("target", kind).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def labelled_lines(df: DataFrame, key: str, text: str, label: str = "^([^:：]+)[:：]") -> DataFrame:
    """(key, label, rest) of each line that starts with a label."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("line"))
    return lines.select(key, F.trim(F.regexp_extract("line", label, 1)).alias("label"), F.trim(F.regexp_replace("line", label, "")).alias("rest")).filter("label <> ''")


def backfill(df: DataFrame, values: DataFrame, key: str | Sequence[str], column: str) -> DataFrame:
    """A column's missing values from another table."""
    other = values.select(*cols(key), F.col(column).alias("_v"))
    return df.join(small(other), cols(key), "left").withColumn(column, F.coalesce(column, "_v")).drop("_v")


def reverse_backfill(rows: DataFrame, feeds: DataFrame, names: DataFrame) -> DataFrame:
    """The scope of rows that have none, from the other side's feeds by the same mechanism.

    ``rows`` has row (unique), id, ids, mechanism and scope, a map of a feeder's name to its ids; ``feeds`` id and
    by_mechanism, a map of a mechanism to the ids it feeds; ``names`` id and name. A feeder counts if it feeds the row's
    id or one of its ids by the row's mechanism; one without a name goes by its id. Nothing found leaves the scope as it is.
    Rows of the same ids and mechanism are looked up once.
    """
    by = ["mechanism", "id", "ids", "_open"]
    edges = feeds.select("id", F.explode("by_mechanism").alias("mechanism", "to")).select(F.col("id").alias("feeder"), "mechanism", F.explode("to").alias("target"))
    rows = rows.withColumn("_open", F.coalesce(F.size("scope"), F.lit(0)) <= 0)
    once = asked_once(rows.filter("_open"), by, "row")
    sites = index_ids(once.select("row", "mechanism", "id", "ids"), "id", "ids", "target")
    found = sites.join(edges, ["target", "mechanism"]).join(names.select(F.col("id").alias("feeder"), "name"), "feeder", "left")
    per = found.groupBy("row", F.coalesce("name", "feeder").alias("name")).agg(F.array_sort(F.collect_set("feeder")).alias("ids"))
    scope = per.groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "ids")))).alias("_scope"))
    return to_all(rows, once, scope, by, "row", "left").withColumn("scope", F.coalesce("_scope", "scope")).drop("_scope", "_open")


def override(df: DataFrame, values: DataFrame, key: str | Sequence[str], column: str) -> DataFrame:
    """Another table's value where it has one."""
    other = values.select(*cols(key), F.col(column).alias("_v"))
    return df.join(small(other), cols(key), "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def carry_over(current: DataFrame, legacy: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Adds the rows of an older table whose key is missing."""
    return current.unionByName(legacy.join(current.select(*cols(key)).distinct(), cols(key), "left_anti"), allowMissingColumns=True)


def member_rows(groups: DataFrame, group: str, ids: str, name: str, order: str) -> DataFrame:
    """A row for each id of a member, one with its name when it has none; an id's first row in a group only."""
    flat = groups.select(group, name, order, F.explode_outer(ids).alias("member_id"))
    keyed = flat.withColumn("_k", F.coalesce(F.col("member_id").cast("string"), F.concat(F.lit("name:"), F.col(name))))
    return first_by(keyed, [group, "_k"], [order]).drop("_k")


def fold_core(members: DataFrame, cores: DataFrame, group: str, key: str, coverage: str) -> DataFrame:
    """Members that are cores of their group go, and their coverage goes to the core."""
    moved = members.join(cores.select(group, key).distinct(), [group, key], "left_semi").groupBy(group, key).agg(F.sum(coverage).alias("_c"))
    kept = members.join(cores.select(group, key).distinct(), [group, key], "left_anti").withColumn("role", F.lit("member"))
    core = cores.join(moved, [group, key], "left").withColumn(coverage, F.coalesce(coverage, F.lit(0)) + F.coalesce("_c", F.lit(0))).drop("_c").withColumn("role", F.lit("core"))
    return core.unionByName(kept, allowMissingColumns=True)


def prefixed(s: Column, prefix: str) -> Column:
    """With the prefix, once."""
    return F.when(s.startswith(prefix), s).otherwise(F.concat(F.lit(prefix), s))


def until_marker(s: Column, marker: str) -> Column:
    """What stands before a marker."""
    return F.substring_index(s, marker, 1)


def upsert_owned(current: DataFrame, incoming: DataFrame, key: str, source: str, owner: str) -> DataFrame:
    """Incoming rows replace or join the table; the owner's rows that no longer come are deleted, others' rows stay."""
    stay = current.join(incoming.select(key), key, "left_anti").filter(~F.col(source).eqNullSafe(F.lit(owner)))
    return stay.unionByName(incoming.withColumn(source, F.lit(owner)).select(*current.columns))


def alias_owner(aliases: DataFrame, area: str, alias: str, entity: str, forced: str, order: str) -> DataFrame:
    """Each alias of an area goes to one entity: forced ones first, then the earliest."""
    return first_by(aliases, [area, alias], [F.desc(forced), order]).select(area, alias, entity)


def slim_aliases(aliases: DataFrame, alias: str, entity: str, prefixes: Sequence[str], needed: DataFrame) -> DataFrame:
    """District-prefixed aliases go unless they are needed or what follows the prefix names several entities."""
    pattern = f"^({'|'.join(prefixes)})"
    rest = aliases.withColumn("_rest", F.regexp_replace(alias, pattern, ""))
    owners = rest.groupBy("_rest").agg(F.countDistinct(entity).alias("_n"))
    marked = rest.join(owners, "_rest").join(needed.select(alias).distinct().withColumn("_need", F.lit(True)), alias, "left")
    keep = ~F.col(alias).rlike(pattern) | F.coalesce("_need", F.lit(False)) | (F.col("_n") > 1)
    return marked.filter(keep).select(*aliases.columns)


def label_first(df: DataFrame, key: str, items: str, label: str) -> DataFrame:
    """A row for each item, with the label on the first only."""
    rows = df.select(key, F.col(label).alias("_l"), F.posexplode(items).alias("pos", "item"))
    return rows.select(key, "pos", "item", F.when(F.col("pos") == 0, F.col("_l")).otherwise("").alias(label))


def feed_build(resolved: DataFrame, points: DataFrame, reasons: DataFrame, identity: str, order: str, area: str) -> DataFrame:
    """Each id's first resolved row; points that none covers become gap rows with their area's reason."""
    first = first_by(resolved, identity, [order]).withColumn("gap", F.lit(None).cast("string"))
    gaps = points.join(first.select(identity), identity, "left_anti").join(small(reasons.select(area, F.col("reason").alias("gap"))), area, "left")
    return first.unionByName(gaps, allowMissingColumns=True)


def build_entities(rows: DataFrame, area: str, name: Column, stage: str, identity: str, order: str, denied: Sequence[str] = ()) -> DataFrame:
    """Rows without denied names, one a (key, stage), with the surrogate key of (area, name)."""
    from tessera.functions.names import surrogate_key

    keyed = rows.filter(~F.coalesce(name.isin(*denied), F.lit(False))) if denied else rows
    keyed = keyed.withColumn(identity, surrogate_key(F.col(area).cast("string"), F.col(area).cast("string"), name))
    return first_by(keyed, [identity, stage], [order])
