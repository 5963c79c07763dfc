"""Orders with explicit rules for nulls and ties, groups for display, and top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.common import materialised


def metric_order(last: Column, metric: Column, ties: Sequence[str | Column], descending: bool = True) -> list[Column]:
    """O1: rows with ``last`` false first, then by metric with nulls at the end in either direction, then by ties."""
    ordered = metric.desc_nulls_last() if descending else metric.asc_nulls_last()
    return [last.asc(), ordered, *[F.col(t) if isinstance(t, str) else t for t in ties]]


def level_order(level: Column, *then: Column, unknown: int = 99) -> list[Column]:
    """O2: by level, unknown ones last, then as given."""
    return [F.coalesce(level, F.lit(unknown)).asc(), *then]


def collated(name: Column, locale: str | None = None) -> Column:
    """O3: a name in a locale's order, or in binary order."""
    return F.collate(name, locale) if locale else name


def ranked(df: DataFrame, order: Sequence[Column], out: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """Numbers rows from 1 in an order within each group; without groups by a range sort, so that no task holds all rows.

    Without groups, places are a global sort's: rows of the partitions before plus the place in the own one. The sorted
    table is materialised once, so that the sizes and the places are those of one and the same sort.
    """
    if within:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*within).orderBy(*order)))
    ordered = materialised(df.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()))
    # an id is the partition's number, then the row's in 33 bits
    part = F.shiftright("_i", 33)
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_s"))
    before = sizes.select("_p", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a partition
    numbered = ordered.withColumn("_p", part).join(F.broadcast(before), "_p")
    return numbered.withColumn(out, (F.col("_i").bitwiseAND((1 << 33) - 1) + F.col("_b") + 1).cast("long")).drop("_p", "_i", "_b")


def metric_switch(metrics: Mapping[str, Column], name: str) -> Column:
    """The metric of that name."""
    return metrics[name]


def grouped(df: DataFrame, group: str, fixed: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds ``group_no`` (fixed order; unknown groups after it by name; rows without a group last) and ``place`` within the group."""
    known = F.array_position(F.array(*map(F.lit, fixed)), F.col(group)) if fixed else F.lit(0)
    bucket = F.when(F.col(group).isNull(), len(fixed) + 2).when(known > 0, known).otherwise(len(fixed) + 1)
    groups = df.select(group).distinct().withColumn("_b", bucket)
    numbered = groups.withColumn("group_no", F.row_number().over(W.orderBy("_b", group)))  # one row a group
    out = df.join(numbered.select(F.col(group).alias("_g"), "group_no"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return out.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def suggestions(df: DataFrame, keyword: str, name: str, area_rank: str, stage_rank: str, limit: int = 20) -> DataFrame:
    """Names that hold the keyword: exact ones first, then by area, stage and name."""
    hit = df.filter(F.col(name).contains(keyword))
    return hit.orderBy((F.col(name) != keyword).cast("int"), F.coalesce(area_rank, F.lit(9)), F.coalesce(stage_rank, F.lit(9)), name).limit(limit)


def recommendations(df: DataFrame, name: str, order: str, key: Column) -> DataFrame:
    """Distinct names by a sort key, then by name."""
    return df.groupBy(name).agg(F.min(order).alias("_o")).withColumn("sort_key", key).drop("_o").orderBy("sort_key", name)


def medal_order(gold: str, silver: str, bronze: str, name: str) -> list[Column]:
    """O9."""
    total = F.col(gold) + F.col(silver) + F.col(bronze)
    return [F.desc(gold), F.desc(silver), F.desc(bronze), total.desc(), F.col(name)]


def canonical_order(values: str, order: Sequence[str]) -> Column:
    """An array's members in a fixed order."""
    return F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(values, x))


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= k)
