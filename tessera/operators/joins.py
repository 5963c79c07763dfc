"""Joins and lookups. Dimension sides are broadcast only below a checked size; every "first" has a total order."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import geo, names
from tessera.operators.common import cols, first_by, holding, materialised, small
from tessera.operators.contains import occurring


def lookup(facts: DataFrame, dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join to a dimension or to figures by key."""
    return facts.join(small(dim), cols(key), "left")


def first_match(facts: DataFrame, dim: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Left join to the first dimension row of each key."""
    return facts.join(first_by(dim, key, order), cols(key), "left")


def last_write(primary: DataFrame, override: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """One row a key: the last one, and rows of the second table before any of the first."""
    both = primary.withColumn("_src", F.lit(0)).unionByName(override.withColumn("_src", F.lit(1)))
    return first_by(both, key, [F.desc("_src"), F.desc(order)]).drop("_src")


def index_ids(df: DataFrame, one: str, many: str, name: str = "id") -> DataFrame:
    """A row for each distinct id of a single-id and an id-array column."""
    ids = F.array_distinct(F.array_compact(F.concat(F.array(one), F.coalesce(many, F.array()))))
    return df.withColumn(name, F.explode(ids))


def keep_first_maps(df: DataFrame, key: str, order: str, maps: str) -> DataFrame:
    """The maps of each key's rows as one; of an entry that several have, the first stays."""
    flat = df.select(key, order, F.explode(maps).alias("k", "v"))
    one = flat.groupBy(key, "k").agg(F.min_by("v", order).alias("v"))
    return one.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(maps))


def member_maps(schools: DataFrame, key: str, rows: DataFrame, one: str, many: str, order: str, maps: str) -> DataFrame:
    """Each school with the maps of all rows that list it, alone or among several, as one; of an entry that several have, the first stays."""
    listed = index_ids(rows.select(one, many, order, maps), one, many, key)
    merged = keep_first_maps(listed.join(schools.select(key).distinct(), key, "left_semi"), key, order, maps)
    return schools.join(merged, key, "left")


def reverse_lookup(long: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """A long table serves lookups from either side by a filter."""
    return long.filter(F.col(key).isin(*wanted))


def first_nonzero(*values: str) -> Column:
    """The first value that is neither null nor 0, else the last one."""
    return F.coalesce(*[F.nullif(F.col(v), F.lit(0)) for v in values[:-1]], F.col(values[-1]))


def coverage(df: DataFrame, key: str, value: Column, order: Sequence[str | Column], most: int) -> DataFrame:
    """Of each key the rows with the largest values, numbered from 1."""
    w = W.partitionBy(key).orderBy(value.desc(), *order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def merge_outer(left: DataFrame, right: DataFrame, key: str | Sequence[str], sort_by: str) -> DataFrame:
    """Full outer merge, ordered by a measure (null as 0) from large to small, then by key."""
    return left.join(right, cols(key), "full_outer").orderBy(F.coalesce(sort_by, F.lit(0)).desc(), *cols(key))


def coverage_merge(df: DataFrame, key: str, amount: str, area: str, identity: str, order: str, most: int) -> DataFrame:
    """Per key the sum, the distinct areas and the first id; the largest sums only."""
    out = df.groupBy(key).agg(F.sum(amount).alias("total"), F.array_sort(F.collect_set(area)).alias("areas"), F.min_by(identity, order).alias("first_id"))
    return out.orderBy(F.desc("total"), key).limit(most)


def positional(left: DataFrame, right: DataFrame, key: str | Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The k-th row of a key with the k-th row of the other side; rows without a partner stay on the left."""
    nth = lambda df, order: df.withColumn("_k", F.row_number().over(W.partitionBy(*cols(key)).orderBy(*order)))
    return nth(left, left_order).join(nth(right, right_order), [*cols(key), "_k"], "left").withColumnRenamed("_k", "k")


def append_missing(rows: DataFrame, every: DataFrame, *keys: str) -> DataFrame:
    """Adds what the second table has and the first lacks by each of the keys; measures are null."""
    for key in keys:
        every = every.join(rows.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows.unionByName(every, allowMissingColumns=True)


def unmatched(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right, cols(key), "left_anti")


def claim_once(claims: DataFrame, item: str, explicit: str, order: str) -> DataFrame:
    """Each item goes to one claim: explicit ones first, then the earliest; the others are marked as not granted."""
    w = W.partitionBy(item).orderBy(F.desc(explicit), order)
    return claims.withColumn("granted", F.row_number().over(w) == 1)


#: Cells through which the nearest site is sought one after another, in degrees.
NEAREST_STEPS = (0.005, 0.08, 1.28)


def nearest(points: DataFrame, sites: DataFrame, area: str, point_id: str, site_id: str, site_order: str, steps: Sequence[float] = NEAREST_STEPS) -> DataFrame:
    """Of each point the nearest site of its area: (point_id, site_id, metres); the first of equally near ones.

    Both tables have lng and lat; rows that lack one have no part in it. A point meets the sites of its own and the eight
    cells around it; the nearest of them is the nearest of all if it is no farther than a site outside can be. The other
    points go on to a wider grid, and what no grid settles is compared with all sites of its area.
    """
    s = sites.select(area, F.col(site_id).alias("_site"), F.col(site_order).alias("_ord"), F.col("lng").alias("_lng"), F.col("lat").alias("_lat")).dropna(subset=["_lng", "_lat"])
    left = points.select(area, F.col(point_id).alias("_point"), "lng", "lat").dropna(subset=["lng", "lat"]).distinct()
    best = F.min(F.struct(geo.metres(F.col("lng"), F.col("lat"), F.col("_lng"), F.col("_lat")).alias("d"), "_ord", "_site")).alias("b")
    own = [area, "_point", "lng", "lat"]
    settled = []
    for step in steps:
        around = _cells(s.withColumnsRenamed({"_lng": "lng", "_lat": "lat"}), step, step, True).withColumnsRenamed({"lng": "_lng", "lat": "_lat"})
        met = _cells(left, step, step, False).join(around, [area, "_x", "_y"]).groupBy(*own).agg(best)
        # a site outside is a cell's height away, or beyond the meridian a cell's width away or that of 180 degrees
        beyond = lambda degrees: F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.least(degrees, F.lit(90.0)))))
        bound = 0.999 * geo.EARTH_M * F.least(F.lit(math.radians(step)), beyond(F.lit(step)), beyond(180 - F.abs("lng")))
        near = materialised(left.join(met, own, "left").withColumn("sure", F.coalesce(F.col("b.d") <= bound, F.lit(False))))
        settled.append(near.filter("sure").select("_point", "b"))
        left = near.filter("not sure").select(*own)
    settled.append(left.join(small(s), area).groupBy("_point").agg(best))
    every = reduce(DataFrame.unionByName, settled).groupBy("_point").agg(F.min("b").alias("b"))
    return every.select(F.col("_point").alias(point_id), F.col("b._site").alias(site_id), F.col("b.d").alias("metres"))


def _cells(df: DataFrame, degrees_lng: float, degrees_lat: float, around: bool) -> DataFrame:
    x, y = F.floor(F.col("lng") / degrees_lng), F.floor(F.col("lat") / degrees_lat)
    if not around:
        return df.withColumn("_x", x).withColumn("_y", y)
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    return df.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).withColumn("_x", x + F.col("_dx")).withColumn("_y", y + F.col("_dy")).drop("_dx", "_dy")


def within_radius(points: DataFrame, sites: DataFrame, radius_m: float, point_id: str, site_id: str, max_lat: float = 60.0) -> DataFrame:
    """Pairs (point_id, site_id, metres) within a radius, by a grid whose cells are as wide as the radius up to ``max_lat`` degrees.

    Only neighbouring cells are joined: an equi-join, not a comparison of everything with everything.
    """
    lat_step = radius_m / 111_000.0
    lng_step = lat_step / math.cos(math.radians(max_lat))
    a = _cells(points.select(point_id, "lng", "lat"), lng_step, lat_step, False)
    b = _cells(sites.select(site_id, "lng", "lat"), lng_step, lat_step, True).select(F.col(site_id), F.col("lng").alias("_lng"), F.col("lat").alias("_lat"), "_x", "_y")
    d = geo.metres(F.col("lng"), F.col("lat"), F.col("_lng"), F.col("_lat"))
    return a.join(b, ["_x", "_y"]).withColumn("metres", d).filter(F.col("metres") <= radius_m).select(point_id, site_id, "metres")


def radius_ids(points: DataFrame, sites: DataFrame, radius_m: float, point_id: str, site_id: str) -> DataFrame:
    """Each point's sites within a radius as a sorted array, empty for none."""
    found = within_radius(points, sites, radius_m, point_id, site_id).groupBy(point_id).agg(F.sort_array(F.collect_set(site_id)).alias("sites"))
    return points.select(point_id).join(found, point_id, "left").withColumn("sites", F.coalesce("sites", F.array().cast(found.schema["sites"].dataType)))


def proximity_pairs(points: DataFrame, radius_m: float, same: Sequence[str], point_id: str, exempt: DataFrame | None = None) -> DataFrame:
    """Pairs i < j of points within a radius that agree in the ``same`` columns, less exempt pairs (i, j)."""
    lat_step = radius_m / 111_000.0
    lng_step = lat_step / math.cos(math.radians(60.0))
    a = _cells(points, lng_step, lat_step, False).select(*same, F.col(point_id).alias("i"), "lng", "lat", "_x", "_y")
    b = _cells(points, lng_step, lat_step, True).select(*same, F.col(point_id).alias("j"), F.col("lng").alias("_lng"), F.col("lat").alias("_lat"), "_x", "_y")
    d = geo.metres(F.col("lng"), F.col("lat"), F.col("_lng"), F.col("_lat"))
    out = a.join(b, [*same, "_x", "_y"]).filter("i < j").withColumn("metres", d).filter(F.col("metres") <= radius_m).select(*same, "i", "j", "metres")
    return out.join(exempt, ["i", "j"], "left_anti") if exempt is not None else out


def merge_points(points: DataFrame, point_id: str, identity: str, place: Sequence[str], order: str) -> DataFrame:
    """Points of one id, or else of one place, as one. Adds ``merged``, the first point of the group.

    A point with an id joins its id's group; one without joins the group of the first point with an id at its place, or else its place's own.
    """
    firsts = points.filter(F.col(identity).isNotNull()).groupBy(identity).agg(F.min_by(point_id, order).alias("_of_id"))
    named = points.join(firsts, identity, "left")
    at_place = named.groupBy(*place).agg(F.min_by("_of_id", F.when(F.col("_of_id").isNotNull(), F.col(order))).alias("_named"), F.min_by(point_id, order).alias("_any"))
    return named.join(at_place, list(place)).withColumn("merged", F.coalesce("_of_id", "_named", "_any")).drop("_of_id", "_named", "_any")


def gap_groups(df: DataFrame, partition: Sequence[str], by: str, gap: float) -> DataFrame:
    """Numbers clusters of values along one axis; a gap wider than given starts a new one."""
    w = W.partitionBy(*partition).orderBy(by)
    new = F.when(F.col(by) - F.lag(by).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def nearest_value(left: DataFrame, right: DataFrame, area: str, left_id: str, left_value: str, right_id: str, right_value: str) -> DataFrame:
    """Of each left row the right row of its area with the nearest value, the smaller id of equals.

    Both sides are sorted together once upwards and once downwards, and each left row takes the right one before it: no pairs are built.
    """
    values = right.filter(F.col(right_value).isNotNull()).groupBy(area, F.col(right_value).alias("_v")).agg(F.min(right_id).alias("_r"))
    rows = left.filter(F.col(left_value).isNotNull()).select(area, F.col(left_value).alias("_v"), F.col(left_id).alias("_l"), F.lit(1).alias("_left"), F.lit(None).cast(values.schema["_r"].dataType).alias("_r"))
    both = rows.unionByName(values.select(area, "_v", F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), F.lit(0).alias("_left"), "_r"))
    held = F.when(F.col("_left") == 0, F.struct("_v", "_r"))
    last = lambda order: F.last(held, ignorenulls=True).over(W.partitionBy(area).orderBy(order, "_left").rowsBetween(W.unboundedPreceding, 0))
    near = both.withColumn("_low", last(F.asc("_v"))).withColumn("_high", last(F.desc("_v"))).filter("_left = 1")
    found = near.select(F.col("_l").alias(left_id), "_v", F.explode(F.array("_low", "_high")).alias("_c")).filter("_c is not null")
    best = found.groupBy(left_id).agg(F.min(F.struct(F.abs(F.col("_v") - F.col("_c._v")).alias("gap"), F.col("_c._r").alias(right_id))).alias("b"))
    return best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.gap").alias("gap"))


def spill_conflicts(df: DataFrame, group: str, identity: str, name: str, order: str) -> DataFrame:
    """The key of each row: its id, but for an id's second and later names in a group, and without an id, the name."""
    nth = F.row_number().over(W.partitionBy(group, identity).orderBy(order))
    use = F.col(identity).isNotNull() & (nth == 1)
    return df.withColumn("key", F.when(use, F.col(identity).cast("string")).otherwise(F.col(name))).withColumn("by_id", use)


def reconcile(official: DataFrame, held: DataFrame, key: str, stage: str, wanted: str) -> DataFrame:
    """MATCHED, CROSS (held in other stages only) or MISSING for each official key."""
    facts = held.groupBy(key).agg(F.max((F.col(stage) == wanted).cast("int")).alias("_own"))
    status = F.when(F.col("_own") == 1, "MATCHED").when(F.col("_own") == 0, "CROSS").otherwise("MISSING")
    return official.select(key).distinct().join(facts, key, "left").select(key, status.alias("status"))


def refresh_tiered(rows: DataFrame, fresh: DataFrame, line: str, name: str, order: str, spread_m: float) -> DataFrame:
    """New coordinates by (line, name), else by name alone; ``conflict`` if the name's places are further apart than given.

    ``rows`` and ``fresh`` have lng and lat.
    """
    of_line = first_by(fresh, [line, name], [order]).select(line, name, F.col("lng").alias("_l1"), F.col("lat").alias("_a1"))
    of_name = first_by(fresh, [name], [order]).select(name, F.col("lng").alias("_l2"), F.col("lat").alias("_a2"))
    box = fresh.groupBy(name).agg(*[f(c).alias(f"_{n}_{c}") for c in ("lng", "lat") for n, f in (("min", F.min), ("max", F.max))])
    far = geo.metres(F.col("_min_lng"), F.col("_min_lat"), F.col("_max_lng"), F.col("_max_lat")) > spread_m
    out = rows.join(of_line, [line, name], "left").join(of_name, [name], "left").join(box, [name], "left")
    tier = F.when(F.col("_l1").isNotNull(), "line").when(F.col("_l2").isNotNull(), "name").otherwise("kept")
    new = lambda c, p: F.coalesce(f"_{p}1", f"_{p}2", c)
    conflict = F.col("_l1").isNull() & F.coalesce(far, F.lit(False))
    return out.select(*[c for c in rows.columns if c not in ("lng", "lat")], new("lng", "l").alias("lng"), new("lat", "a").alias("lat"), tier.alias("tier"), conflict.alias("conflict"))


def two_way_gap(official: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one of two lists has."""
    a, b = official.select(key).distinct(), held.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("official_only")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("held_only")))


def listed_gap(official: DataFrame, held: DataFrame, norm: Callable[[Column], Column] = names.strict_norm_spaces) -> DataFrame:
    """(list, side, name) of official names that no held row of their list has, and of held rows that have none of their list's names.

    ``official`` has list and name; ``held`` list, id, name and aliases. Names are compared normalised; a null name of
    either table meets nothing.
    """
    asked = official.select("list", "name", norm(F.col("name")).alias("key")).distinct()
    flat = held.select("list", "id", "name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).filter("n is not null").select("list", "id", "name", norm(F.col("n")).alias("key")).filter("key <> ''")
    lacking = asked.join(flat, ["list", "key"], "left_anti").select("list", F.lit("official_only").alias("side"), "name")
    known = flat.join(asked.filter("name is not null"), ["list", "key"], "left_semi").select("list", "id").distinct()
    return lacking.union(held.join(known, ["list", "id"], "left_anti").select("list", F.lit("held_only").alias("side"), "name"))


def member_gap(official: DataFrame, held: DataFrame, entities: DataFrame, norm: Callable[[Column], Column] = names.brand_core) -> DataFrame:
    """Official members that a group neither has as a member nor as a member's campus, with the ids of the entities of that name.

    ``official`` has group and member; ``held`` group, member and campuses (an array); ``entities`` id, name and aliases.
    An id is found by the member's name up to a full-width bracket, among names and aliases; ``ids`` is sorted, empty for none.
    """
    every = lambda one, many: F.explode(F.concat(F.array(one), F.coalesce(many, F.array().cast("array<string>"))))
    key = lambda c: F.coalesce(norm(F.col(c)), F.lit(""))
    have = held.select(key("group").alias("_g"), every("member", "campuses").alias("n")).select("_g", key("n").alias("_m")).distinct()
    lacking = official.withColumn("_g", key("group")).withColumn("_m", key("member")).join(have, ["_g", "_m"], "left_anti").select("group", "member")
    lacking = lacking.withColumn("_k", norm(F.split("member", "（")[0]))
    flat = entities.select("id", every("name", "aliases").alias("n")).select("id", norm(F.col("n")).alias("_k")).filter("_k <> ''").join(lacking.select("_k").distinct(), "_k", "left_semi")
    ids = flat.groupBy("_k").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return lacking.join(ids, "_k", "left").select("group", "member", F.coalesce("ids", F.array().cast(ids.schema["ids"].dataType)).alias("ids"))


def contained_either_way(left: DataFrame, right: DataFrame, area: str, left_name: str, right_name: str, right_order: str) -> DataFrame:
    """The first right row of a left row's area such that one base name holds the other; an empty name holds and is held by none."""
    r = right.select(area, F.col(right_name).alias("_r"), F.col(right_order).alias("_o"))
    pairs = holding(left, left_name, r, "_r", [area]).join(r, [area, "_r"])
    found = pairs.groupBy(area, left_name).agg(F.min_by("_r", "_o").alias("match"))
    return left.join(found, [area, left_name], "left")


def corpus_hits(names: DataFrame, name: str, corpus: DataFrame, text: str) -> DataFrame:
    """Whether some text of a corpus holds each name. The texts are scanned once for all names (see contains.py)."""
    hit = occurring(names, name, corpus, text)
    return names.join(hit.withColumn("hit", F.lit(1)), name, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def document_lookup(docs: DataFrame, ids: str, doc_name: str, schools: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Of each school the first document that lists its id, else the first with its name."""
    by_id = docs.select(F.explode(ids).alias(key), F.col(order).alias("_o1")).groupBy(key).agg(F.min("_o1").alias("_by_id"))
    by_name = docs.groupBy(F.col(doc_name).alias(name)).agg(F.min(order).alias("_by_name"))
    return schools.join(by_id, key, "left").join(by_name, name, "left").withColumn("document", F.coalesce("_by_id", "_by_name")).drop("_by_id", "_by_name")
