"""Composed views: the outcome indicators and the denormalised documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import aggregates, joins
from tessera.operators.common import small


def quota_outcome(rows: DataFrame, key: str, year: str, score: Column, city: Column, top: Column, current: int, years: Sequence[int]) -> DataFrame:
    """Per key, for city, other and top pairs: least score, pairs, failed pairs and rate of the current year, and the mean of the years' least scores."""
    kinds = {"city": city, "other": ~city, "top": top}
    now = aggregates.outcome(rows.filter(F.col(year) == current), key, score, kinds)
    mean = aggregates.mean_of_years(rows, key, year, score, years, kinds)
    return mean.join(now, key, "full_outer")


def linkage(quota: DataFrame, scores: DataFrame, district: DataFrame, key: Sequence[str], amount: str, score: str) -> DataFrame:
    """Quota and score rows of a pair as one, with the district's own rows: source, amount, least score, order within the outer key."""
    merged = quota.join(scores, list(key), "full_outer").withColumn("source", F.when(F.col(amount).isNull(), "score").when(F.col(score).isNull(), "quota").otherwise("both"))
    own = district.withColumn("source", F.lit("district"))
    rows = merged.unionByName(own, allowMissingColumns=True)
    place = F.row_number().over(W.partitionBy(key[0]).orderBy(F.coalesce(amount, F.lit(0)).desc(), *key[1:], "source"))
    return rows.withColumn("place", place)


def detail(entities: DataFrame, key: str, facts: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Each entity with its facts as sorted arrays of structs, one column a fact table."""
    out = entities
    for name, table in facts.items():
        columns = [c for c in [*order, *table.columns] if c in table.columns and c != key]
        nested = table.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*dict.fromkeys(columns)))).alias(name))
        out = out.join(nested, key, "left")
    return out


def info_card(entities: DataFrame, labels: Sequence[tuple[str, Column]], none: str = "未查到") -> DataFrame:
    """(label, value) signals in order; a missing value has a fallback text."""
    signals = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(value.cast("string"), F.lit(none)).alias("value")) for label, value in labels])
    return entities.withColumn("signals", signals)


def point_view(points: DataFrame, plates: DataFrame, stations: DataFrame, area: str, point_id: str, radius_m: float = 1200.0) -> DataFrame:
    """Points merged by identity or place, each with its nearest plate and the stations near it."""
    firsts = points.filter(F.col("merged") == F.col(point_id))
    near = joins.nearest(firsts, plates, area, point_id, "plate_id", "plate_id").withColumnRenamed("metres", "plate_m")
    around = joins.radius_ids(firsts, stations, radius_m, point_id, "station_id")
    return firsts.join(near, point_id, "left").join(around, point_id, "left")


def high_ranking(scores: DataFrame, key: str, name: str, year: str, batch: str, value: str, batches: Sequence[int], digits: int = 4) -> DataFrame:
    """Per key the largest value of each year in the preferred batch, and the mean over all years."""
    chosen = aggregates.preferred(scores, key, batch, batches)
    return aggregates.pooled(chosen, key, year, value, digits).join(small(scores.groupBy(key).agg(F.min(name).alias(name))), key)


def middle_ranking(rows: DataFrame, metrics: DataFrame, key: str, order: Sequence[str], metric_order: Sequence[str], keep_without: bool = True, every: DataFrame | None = None) -> DataFrame:
    """Rows with the metrics of the same place within their key; entities without a row are appended on request."""
    out = joins.positional(rows, metrics, key, order, metric_order)
    return joins.append_missing(out, every, key) if keep_without and every is not None else out
