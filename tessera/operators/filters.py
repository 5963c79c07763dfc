"""Predicates and filters. ``None`` selects everything, an empty selection nothing, unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import small


def by_area_and_keyword(df: DataFrame, area: str, name: str, areas: Iterable | None = None, keyword: str | None = None) -> DataFrame:
    """rows of the areas whose name holds the trimmed keyword; no areas or an empty keyword don't limit."""
    keyword = (keyword or "").strip()
    out = df.filter(F.col(area).isin(*areas)) if areas else df
    return out.filter(F.col(name).contains(keyword)) if keyword else out


@dataclass(frozen=True)
class Selection:
    """selected values of a filter panel; every change gives a new selection."""

    stages: frozenset
    classes: frozenset
    natures: frozenset
    areas: frozenset
    plates: frozenset = frozenset()
    stations: frozenset = frozenset()

    def toggled(self, field: str, value) -> Selection:
        return replace(self, **{field: getattr(self, field) ^ {value}})

    def flipped(self, field: str, universe: Iterable) -> Selection:
        """All of the universe if something is missing, else nothing."""
        every = frozenset(universe)
        return replace(self, **{field: frozenset() if every <= getattr(self, field) else every})

    def has_all(self, field: str, universe: Iterable) -> bool:
        return frozenset(universe) <= getattr(self, field)


def _member(column: Column, values: frozenset) -> Column:
    return column.isin(*sorted(values)) if values else F.lit(False)


def visible(selection: Selection, parts: str = "parts", area: str = "area", plate: str = "plate", station: str = "station") -> Column:
    """some part's stage, class and nature are all selected, and the place is: a plate or station selection replaces the areas."""
    shown = F.exists(parts, lambda p: _member(p["stage"], selection.stages) & _member(p["class"], selection.classes) & _member(p["nature"], selection.natures))
    if selection.plates or selection.stations:
        place = _member(F.col(plate), selection.plates) | _member(F.col(station), selection.stations)
    else:
        place = _member(F.col(area), selection.areas)
    return F.coalesce(shown & place, F.lit(False))


def any_of(*conditions: Column) -> Column:
    """OR of the selected kinds; none selected is false."""
    return reduce(or_, conditions, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions, F.lit(True))


def in_stage(stage: Column, wanted: str, composite: Mapping[str, Sequence[str]] | None = None) -> Column:
    """stage equality, where a composite stage stands for several."""
    return stage.isin(wanted, *(composite or {}).get(wanted, ()))


def keep_members(values: str, allowed: Sequence) -> Column:
    """an array's allowed members, null if none is left."""
    kept = F.filter(values, lambda x: x.isin(*allowed))
    return F.when(F.size(kept) > 0, kept)


def has_any(values: Column, wanted: Sequence[str], known: Sequence[str], other: str = "other") -> Column:
    """the array meets the wanted values; ``other`` stands for having none of the known ones."""
    named = [w for w in wanted if w != other]
    hit = F.arrays_overlap(values, F.array(*map(F.lit, named))) if named else F.lit(False)
    rest = ~F.arrays_overlap(values, F.array(*map(F.lit, known))) if other in wanted else F.lit(False)
    return F.coalesce(hit, F.lit(False)) | F.coalesce(rest, F.lit(other in wanted))


def all_ids(one: str, many: str) -> Column:
    """the distinct ids of a single-id and an id-array column."""
    return F.array_distinct(F.array_compact(F.concat(F.array(one), F.coalesce(many, F.array().cast("array<string>")))))


def semi_by_ids(df: DataFrame, key: str, facts: DataFrame, one: str, many: str, condition: Column) -> DataFrame:
    """rows whose key is among the ids of facts that meet the condition."""
    ids = facts.filter(condition).select(F.explode(all_ids(one, many)).alias("_id")).distinct()
    return df.join(ids, F.col(key) == F.col("_id"), "left_semi")


def not_listed(name: Column, exact: Sequence[str] = (), prefixes: Sequence[str] = ()) -> Column:
    """F8: not on a deny list of names and prefixes."""
    return ~(F.coalesce(name.isin(*exact), F.lit(False)) | reduce(or_, [name.startswith(p) for p in prefixes], F.lit(False)))


def keyword_gate(name: Column, allow: Sequence[str], deny: Sequence[str]) -> Column:
    """holds an allowed word and no denied one."""
    hold = lambda words: reduce(or_, [name.contains(w) for w in words], F.lit(False))
    return hold(allow) & ~hold(deny)


def listed_or_campus(name: Column, listed: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """a listed name, alone or followed by a bracket, and none of the excluded ones."""
    hit = reduce(or_, [(name == n) | name.startswith(n + "（") | name.startswith(n + "(") for n in listed], F.lit(False))
    return hit & ~F.coalesce(name.isin(*excluded), F.lit(False)) if excluded else hit


def data_row(first_cell: Column) -> Column:
    """a table row that starts with a number."""
    return F.trim(first_cell).rlike(r"^\d+$")


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """the allow-listed fields that the table has."""
    return df.select(*[c for c in fields if c in df.columns])


def drop_null_cells(cells: str) -> Column:
    """a map without its null values."""
    return F.map_filter(cells, lambda _, v: v.isNotNull())


def badges(rules: Sequence[tuple[Column, str]]) -> Column:
    """labels of the rules that hold, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(c, label) for c, label in rules]))


def in_both(df: DataFrame, key: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """rows whose key is in both tables."""
    return df.join(left.select(key).distinct(), key, "left_semi").join(right.select(key).distinct(), key, "left_semi")


def search(points: DataFrame, keyword: str, name: str, order: str, aliases: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """F16: the first points whose name holds the keyword; if there are none, those that hold the name of an entity with that alias.

    ``aliases`` has (alias, entity_name).
    """
    direct = points.filter(F.col(name).contains(keyword)).withColumn("_tier", F.lit(0))
    if aliases is not None:
        names = aliases.filter(F.col("alias") == keyword).select("entity_name").distinct()
        by_alias = points.join(small(names), F.col(name).contains(F.col("entity_name")), "left_semi").withColumn("_tier", F.lit(1))
        both = direct.unionByName(by_alias)
        best = both.agg(F.min("_tier").alias("_best"))
        direct = both.join(F.broadcast(best), F.col("_tier") == F.col("_best"), "left_semi")  # one row
    return direct.drop("_tier").orderBy(order).limit(limit)


def count_separators(s: Column, separator: str = "、") -> Column:
    """how often a separator occurs."""
    return F.size(F.split(s, separator)) - 1


def first_rule(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """the label of the first rule that holds."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def honours(values: Column, allowed: Sequence[str], marker: str = "-") -> Column:
    """the allowed honours in their order, or a marker for none."""
    kept = F.filter(F.array(*map(F.lit, allowed)), lambda x: F.array_contains(values, x))
    return F.when(F.size(kept) > 0, F.array_join(kept, "、")).otherwise(marker)
