"""Operations over ordered rows. Every window is partitioned, so order costs a sort per key and never one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import geo
from tessera.operators.common import cols, first_by


def first_by_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """W1."""
    return first_by(df, key, order)


def first_by_place(df: DataFrame, name: str, lng: str, lat: str, order: str, digits: int = 5) -> DataFrame:
    """The first row of each name and rounded place."""
    rounded = df.withColumn("_x", geo.round_half_up(F.col(lng), digits)).withColumn("_y", geo.round_half_up(F.col(lat), digits))
    return first_by(rounded, [name, "_x", "_y"], [order]).drop("_x", "_y")


def forward_fill(df: DataFrame, partition: str | Sequence[str], order: str, value: str, out: str | None = None) -> DataFrame:
    """The last value that isn't null, up to each row."""
    w = W.partitionBy(*cols(partition)).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out or value, F.last(value, ignorenulls=True).over(w))


def attach_to_header(df: DataFrame, partition: str | Sequence[str], order: str, is_header: Column, out: str = "section") -> DataFrame:
    """Numbers the sections that header rows open; rows before the first header are in section 0."""
    w = W.partitionBy(*cols(partition)).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(is_header.cast("int")).over(w))


def stitch(df: DataFrame, partition: str | Sequence[str], order: str, starts: Column, text: str, joiner: str = "") -> DataFrame:
    """The texts of each section joined in order."""
    s = attach_to_header(df, partition, order, starts, "section")
    rows = s.groupBy(*cols(partition), "section").agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_t"))
    return rows.select(*cols(partition), "section", F.array_join(F.transform("_t", lambda t: t[text]), joiner).alias(text), F.size("_t").alias("lines"))


def nth_of_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column], out: str = "k") -> DataFrame:
    """W7."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*cols(key)).orderBy(*order)))
