"""Data-quality checks. Each returns the offending rows, or one row of figures; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import cols


def forbidden_words(df: DataFrame, name: str, words: Sequence[str]) -> DataFrame:
    """Q1, Q17."""
    return df.filter(F.col(name).rlike("|".join(words)))


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Q2, Q12: keys of several rows, with their number."""
    return df.groupBy(*cols(key)).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Q2, Q7: facts whose key isn't null and isn't in the dimension."""
    return facts.filter(F.col(key).isNotNull()).join(dim.select(key), key, "left_anti")


def ambiguous_aliases(aliases: DataFrame, key: Sequence[str], entity: str, is_main: Column) -> DataFrame:
    """Q3: aliases of several entities none of which is the main one."""
    out = aliases.groupBy(*key).agg(F.countDistinct(entity).alias("entities"), F.max(is_main.cast("int")).alias("_m"))
    return out.filter("entities > 1 and _m = 0").drop("_m")


def empty_lists(df: DataFrame, key: str, values: str, allowed: Sequence = ()) -> DataFrame:
    """Q4, Q5."""
    missing = F.coalesce(F.size(values), F.lit(0)) <= 0
    return df.filter(missing & ~F.col(key).isin(*allowed)) if allowed else df.filter(missing)


def round_trip(df: DataFrame, resolved: DataFrame, key: str, entity: str) -> DataFrame:
    """Q6, Q8: rows whose name resolves to another entity than expected."""
    got = resolved.select(key, F.col(entity).alias("_got"))
    return df.join(got, key, "left").filter(~F.col(entity).eqNullSafe(F.col("_got"))).withColumnRenamed("_got", "resolved")


def area_mismatch(facts: DataFrame, dim: DataFrame, key: str, area: str, allowed: DataFrame | None = None) -> DataFrame:
    """Q7: facts whose area is not the dimension's."""
    out = facts.join(dim.select(key, F.col(area).alias("_a")), key).filter(~F.col(area).eqNullSafe(F.col("_a"))).drop("_a")
    return out.join(allowed.select(key), key, "left_anti") if allowed is not None else out


def cross_area_keys(df: DataFrame, key: str, area: str) -> DataFrame:
    """Q9: keys that occur in several areas."""
    return df.groupBy(key).agg(F.countDistinct(area).alias("areas")).filter("areas > 1")


def orphans(df: DataFrame, key: str, required: Mapping[str, DataFrame], condition: Column) -> DataFrame:
    """Q10: rows under the condition that some required table lacks: (key, missing table names)."""
    out = df.filter(condition).select(key).distinct()
    for name, table in required.items():
        out = out.join(table.select(key).distinct().withColumn(f"_has_{name}", F.lit(True)), key, "left")
    lacks = F.array_compact(F.array(*[F.when(F.col(f"_has_{n}").isNull(), n) for n in required]))
    return out.select(key, F.array_join(lacks, ",").alias("missing")).filter("missing <> ''")


def totals(df: DataFrame, sums: Mapping[str, Column], expected: Mapping[str, float]) -> DataFrame:
    """Q13, Q18: (what, got, expected, ok)."""
    one = df.agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("got"), F.lit(float(expected[n])).alias("expected")) for n in sums])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("ok", F.abs(F.col("got") - F.col("expected")) < 1e-6)


def conservation(before: DataFrame, after: DataFrame, amount: str) -> DataFrame:
    """Q18: rows and sums of two layers side by side."""
    side = lambda df, n: df.agg(F.count("*").alias(f"rows_{n}"), F.sum(F.col(amount).cast("decimal(18,2)")).alias(f"sum_{n}"))
    return side(before, "before").crossJoin(side(after, "after"))  # one row each


def excluded_present(facts: DataFrame, excluded: DataFrame, key: str, exceptions: Sequence = ()) -> DataFrame:
    """Q15: facts about excluded entities, but for exceptions."""
    hit = facts.join(excluded.select(key).distinct(), key, "left_semi")
    return hit.filter(~F.col(key).isin(*exceptions)) if exceptions else hit


def not_accepted(df: DataFrame, column: str, accepted: Sequence) -> DataFrame:
    """Q16, Q19: values outside a list."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*accepted))


def unknown_fields(df: DataFrame, allowed: Sequence[str]) -> list[str]:
    """Q19: columns that aren't on the allow list."""
    return [c for c in df.columns if c not in allowed]


def contiguous(df: DataFrame, key: str | Sequence[str], number: str) -> DataFrame:
    """Q20: of each key whether its numbers are 1..n."""
    n = F.countDistinct(number)
    return df.groupBy(*cols(key)).agg(((F.min(number) == 1) & (F.max(number) == n) & (F.count("*") == n)).alias("contiguous"))
