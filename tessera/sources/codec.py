"""Dictionary encoding of columns and list members, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import small
from tessera.operators.ranking import ranked


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, code): distinct values numbered from 0 by first sight. One row a distinct value is sorted, never the table, and no task holds all values."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    return ranked(first, [F.col("_first"), F.col(column)], "_n").select(column, (F.col("_n") - 1).alias("code"))


def worth_encoding(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, uniq, encode): a column is encoded if three times its distinct values are fewer than the rows."""
    counted = df.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("uniq")) for c in columns])
    return counted.select("rows", F.explode(rows).alias("r")).select("r.column", "rows", "r.uniq", (F.col("r.uniq") * 3 < F.col("rows")).alias("encode"))


def worth_encoding_list(df: DataFrame, column: str) -> DataFrame:
    """A list column's members are encoded if twice the distinct ones are fewer than all."""
    members = df.select(F.explode(column).alias("m"))
    return members.agg(F.count("*").alias("refs"), F.countDistinct("m").alias("uniq")).withColumn("encode", F.col("uniq") * 2 < F.col("refs"))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """The column's codes instead of its values; null stays null."""
    return df.join(small(codes), column, "left").drop(column).withColumnRenamed("code", column)


def decode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """The values instead of the codes."""
    back = codes.select(F.col("code").alias("_c"), F.col(column).alias("_v"))
    return df.join(small(back), F.col(column) == F.col("_c"), "left").drop(column, "_c").withColumnRenamed("_v", column)


def split_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A row for each key with its rows as an array in order."""
    columns = list(dict.fromkeys([*order, *(c for c in df.columns if c != key)]))
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))


def trim(df: DataFrame, drop: Sequence[str] = (), nested: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Without columns, and without fields of struct columns."""
    out = df.drop(*drop)
    for column, fields in (nested or {}).items():
        out = out.withColumn(column, F.col(column).dropFields(*fields))
    return out
