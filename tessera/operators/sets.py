"""Set operations and differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import cols


def union_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """All rows of several tables with their table's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in tables.items()])


def union_mapped(sources: Sequence[tuple[DataFrame, Mapping[str, Column | str]]], columns: Sequence[str]) -> DataFrame:
    """Several sources in one schema; each names the column or expression for a target column, missing ones are null."""
    shaped = [df.select(*[(F.col(m[c]) if isinstance(m[c], str) else m[c]).alias(c) if c in m else F.lit(None).alias(c) for c in columns]) for df, m in sources]
    return reduce(DataFrame.unionByName, shaped)


def two_way_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that only one side has, with ``side``."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """U4, Q14: rows that went (-) and came (+), by how many more copies there are."""
    columns = before.columns
    both = before.withColumn("_d", F.lit(-1)).unionByName(after.withColumn("_d", F.lit(1)))
    delta = both.groupBy(*columns).agg(F.sum("_d").alias("delta")).filter("delta <> 0")
    return delta.withColumn("change", F.when(F.col("delta") > 0, "+").otherwise("-"))


def compare_values(left: DataFrame, right: DataFrame, key: str | Sequence[str], value: str) -> DataFrame:
    """Same, differs, left_only or right_only for each key."""
    k = cols(key)
    joined = left.select(*k, F.col(value).alias("_l"), F.lit(1).alias("_a")).join(right.select(*k, F.col(value).alias("_r"), F.lit(1).alias("_b")), k, "full_outer")
    status = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(F.col("_l").eqNullSafe(F.col("_r")), "same").otherwise("differs")
    return joined.select(*k, status.alias("status"))


def deep_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Whether the two rows of a key are structurally equal: members by name in any order, arrays in order."""
    shape = lambda df, name: df.select(key, F.to_json(F.struct(*sorted(c for c in df.columns if c != key))).alias(name))
    return shape(left, "_l").join(shape(right, "_r"), key, "full_outer").select(key, F.coalesce(F.col("_l") == F.col("_r"), F.lit(False)).alias("equal"))


def nested_diff(left: DataFrame, right: DataFrame, key: str, cells: str, limit: int | None = None) -> DataFrame:
    """Cells of two maps that differ: (key, path, left, right), in order."""
    flat = lambda df, name: df.select(key, F.explode(cells).alias("path", name))
    out = flat(left, "left").join(flat(right, "right"), [key, "path"], "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))
    return out.orderBy(key, "path").limit(limit) if limit else out


def confirmed(family: str, known: Column, own: str) -> Column:
    """U8: the confirmed members of a family, null if that is only the row's own id."""
    both = F.array_sort(F.array_intersect(family, known))
    return F.when((F.size(both) > 0) & ~((F.size(both) == 1) & F.array_contains(both, F.col(own))), both)
