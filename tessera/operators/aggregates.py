"""Aggregations. Sums of money go through decimals, so results don't depend on the order of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import geo
from tessera.operators.common import cols, small
from tessera.operators.ranking import ranked


def count_by(df: DataFrame, key: str) -> DataFrame:
    """A1, A10."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def count_by_mapped(df: DataFrame, key: str, mapping: DataFrame, name: str, other: str = "其他") -> DataFrame:
    """A2: counts by a mapped name, unknown keys under one name; with the total."""
    counts = df.join(small(mapping.select(key, name)), key, "left").groupBy(F.coalesce(name, F.lit(other)).alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(W.partitionBy()))


def pair_minimum(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """A3: per pair the least number, whether there is one, and the rows; '' is no number."""
    v = F.nullif(F.col(value), F.lit("")).try_cast("int")
    return df.groupBy(outer, inner).agg(F.min(v).alias("min_value"), F.max(v.isNotNull()).alias("admitted"), F.count("*").alias("rows"))


def outcome(df: DataFrame, key: str, score: Column, kinds: Mapping[str, Column]) -> DataFrame:
    """In one pass, for each kind the least score, the pairs, the pairs without a score and their share (4 decimals, null without pairs)."""
    aggs = []
    for name, condition in kinds.items():
        pairs = F.count(F.when(condition, 1))
        failed = F.count(F.when(condition & score.isNull(), 1))
        aggs += [F.min(F.when(condition, score)).alias(f"{name}_min"), pairs.alias(f"{name}_pairs"), failed.alias(f"{name}_failed"), F.round(F.try_divide(failed, pairs), 4).alias(f"{name}_failed_rate")]
    return df.groupBy(key).agg(*aggs)


def mean_of_years(df: DataFrame, key: str, year: str, score: Column, years: Sequence[int], kinds: Mapping[str, Column], digits: int = 1) -> DataFrame:
    """Mean of the years' least scores over the years that have one."""
    per_year = df.filter(F.col(year).isin(*years)).groupBy(key, year).agg(*[F.min(F.when(c, score)).alias(n) for n, c in kinds.items()])
    return per_year.groupBy(key).agg(*[F.round(F.avg(n), digits).alias(f"{n}_mean") for n in kinds])


def map_sum(cells: str, keep) -> Column:
    """The sum of a map's values whose key is kept."""
    return F.aggregate(F.map_values(F.map_filter(cells, lambda k, v: keep(k))), F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))


def weighted_rate(df: DataFrame, key: str, weight: str, rate: str, digits: int = 4) -> DataFrame:
    """Sum of weight x rate over rated rows, by the weight of rated rows; null without any."""
    w, r = F.col(weight).cast("decimal(18,4)"), F.col(rate).cast("decimal(18,4)")
    rated = F.sum(F.when(F.col(rate).isNotNull(), w))
    return df.groupBy(key).agg(F.round(F.try_divide(F.sum(w * r).cast("double"), rated.cast("double")), digits).alias("expected_rate"), F.count(rate).alias("rated"))


def merge_rows(df: DataFrame, key: str, items: str, amount: str) -> DataFrame:
    """Of each key all items (sorted) and the sum."""
    return df.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list(items))).alias(items), F.sum(amount).alias(amount))


def medal_pivot(df: DataFrame, keys: Sequence[str], medal: str, medals: Sequence[str]) -> DataFrame:
    """Counts by medal as columns; other awards aren't counted but their rows stay."""
    return df.groupBy(*keys).agg(*[F.count(F.when(F.col(medal) == m, 1)).alias(m) for m in medals])


def latest_and_all(df: DataFrame, key: str, year: str, medals: Sequence[str]) -> DataFrame:
    """Medals of the table's latest year and of all years."""
    latest = df.agg(F.max(year).alias("_latest"))
    marked = df.crossJoin(F.broadcast(latest))  # one row
    now = F.col(year) == F.col("_latest")
    return marked.groupBy(key).agg(*[F.sum(F.when(now, F.col(m)).otherwise(0)).alias(f"{m}_latest") for m in medals], *[F.sum(m).alias(f"{m}_all") for m in medals])


def pooled(df: DataFrame, key: str, year: str, value: str, digits: int = 4) -> DataFrame:
    """The largest value of each year, and the mean over all years' values."""
    per = df.groupBy(key, year).agg(F.max(value).alias("top"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return per.withColumn("mean", geo.round_half_up(F.try_divide(F.sum("_s").over(W.partitionBy(key)).cast("double"), F.sum("_n").over(W.partitionBy(key)).cast("double")), digits)).drop("_s", "_n")


def preferred(df: DataFrame, key: str, batch: str, batches: Sequence[int]) -> DataFrame:
    """The rows of each key's first batch out of the preferred ones."""
    own = df.filter(F.col(batch).isin(*batches))
    return own.withColumn("_b", F.min(batch).over(W.partitionBy(key))).filter(F.col(batch) == F.col("_b")).drop("_b")


def control_totals(df: DataFrame, key: str, sums: Mapping[str, Column], expected: DataFrame) -> DataFrame:
    """Sums beside the declared ones, with their differences."""
    got = df.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    want = expected.select(key, *[F.col(n).alias(f"{n}_declared") for n in sums])
    joined = got.join(want, key, "full_outer")
    return joined.select(key, *sums, *[(F.coalesce(n, F.lit(0)) - F.coalesce(f"{n}_declared", F.lit(0))).alias(f"{n}_off") for n in sums])


def total_mismatch(df: DataFrame, key: str, total: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose total is not the sum of the parts."""
    return df.withColumn("parts", sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))).filter(~F.col(total).eqNullSafe(F.col("parts"))).select(key, total, "parts")


def union_maps(df: DataFrame, key: str, maps: str) -> DataFrame:
    """Of each key one map whose arrays hold the distinct members of all."""
    flat = df.select(key, F.explode(maps).alias("k", "v")).select(key, "k", F.explode("v").alias("m")).distinct()
    per = flat.groupBy(key, "k").agg(F.sort_array(F.collect_list("m")).alias("v"))
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(maps))


def dimension(df: DataFrame, columns: Sequence[str], order: str, name: str = "dim_id") -> DataFrame:
    """Distinct tuples numbered from 0 by first sight, with the number of their rows.

    The numbering sorts one row a distinct tuple, never the facts, and no task holds all tuples.
    """
    first = df.groupBy(*columns).agg(F.min(order).alias("_first"), F.count("*").alias("uses"))
    return ranked(first, [F.col("_first"), *map(F.col, columns)], "_n").withColumn(name, F.col("_n") - 1).drop("_first", "_n")


def content_groups(df: DataFrame, members: Sequence[str], order: str) -> DataFrame:
    """Rows whose arrays hold the same members (in any order) share a group: the hash of the sorted arrays."""
    return df.withColumn("content_key", F.md5(F.concat_ws("#", *[F.array_join(F.array_sort(m), ",") for m in members])))


def unique_keys(df: DataFrame, key: str, entity: str) -> DataFrame:
    """Keys of exactly one entity."""
    return df.groupBy(key).agg(F.min(entity).alias(entity), F.max(entity).alias("_m")).filter(F.col(entity) == F.col("_m")).drop("_m")


def families(df: DataFrame, bucket: Sequence[str], entity: str, grouped: DataFrame) -> DataFrame:
    """Buckets with two entities or more, none of which is in a group."""
    per = df.groupBy(*bucket).agg(F.countDistinct(entity).alias("members"), F.min(entity).alias("first_id")).filter("members >= 2")
    taken = df.join(grouped.select(entity).distinct(), entity, "left_semi").select(*bucket).distinct()
    return per.join(taken, list(bucket), "left_anti")


def allocate(plans: DataFrame, points: DataFrame, school: str, campus: str, amount: str) -> DataFrame:
    """Each point's plan: its own campus's, else its school's total if the school has this point only; else null."""
    own = plans.groupBy(school, campus).agg(F.sum(amount).alias("_own"))
    whole = plans.groupBy(school).agg(F.sum(amount).alias("_all"))
    single = points.groupBy(school).agg(F.countDistinct(campus).alias("_n"))
    out = points.join(own, [school, campus], "left").join(whole, school, "left").join(single, school, "left")
    return out.withColumn("plan", F.coalesce("_own", F.when(F.col("_n") == 1, F.col("_all")))).drop("_own", "_all", "_n")


def least_level(df: DataFrame, key: str, level: str) -> DataFrame:
    """A26."""
    return df.groupBy(key).agg(F.min(level).alias(level))


def value_set(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values as a sorted array."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def folded_sum(df: DataFrame, name: str, variants: DataFrame, amount: str) -> DataFrame:
    """Sums by the name that a variant stands for."""
    return df.join(small(variants.select(name, "canonical")), name, "left").groupBy(F.coalesce("canonical", name).alias(name)).agg(F.sum(amount).alias(amount))


def digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and an order-free digest: the sum over rows of 48 bits of their md5."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns])), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).cast("decimal(38,0)").cast("string").alias("digest"))


def trimmed_core(df: DataFrame, key: str, x: str, y: str, share: float = 0.85, least: int = 3) -> DataFrame:
    """Rows without the farthest from the centroid: the nearest ``share`` (``least`` at least) stay, and ties at the cut."""
    own = W.partitionBy(key)
    d = F.pow(F.col(x) - F.avg(x).over(own), 2) + F.pow(F.col(y) - F.avg(y).over(own), 2)
    n = F.count("*").over(own)
    marked = df.withColumn("_d", F.round(d, 9)).withColumn("_keep", F.greatest(F.ceil(n * share), F.lit(least)))
    ranked = marked.withColumn("_r", F.rank().over(own.orderBy("_d")))
    return ranked.filter(F.col("_r") <= F.col("_keep")).drop("_d", "_keep", "_r")


def summary(df: DataFrame, matched: Column) -> DataFrame:
    """Total, matched, unmatched."""
    return df.agg(F.count("*").alias("total"), F.count_if(matched).alias("matched"), F.count_if(~matched).alias("unmatched"))


def strictest(df: DataFrame, key: str, value: str, ranks: Mapping[str, int], member: str) -> DataFrame:
    """Of each key the value with the highest rank, and the distinct members."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(value)), F.lit(-1))
    return df.groupBy(key).agg(F.max_by(value, F.struct(rank, value)).alias(value), F.array_size(F.collect_set(member)).alias("members"))


def expand_members(groups: DataFrame, members: str, name: str = "member") -> DataFrame:
    """A row for each member, the array kept."""
    return groups.withColumn(name, F.explode(members))


def focus_box(df: DataFrame, lng: str, lat: str, least: float = 0.012, shrink: float = 0.7) -> DataFrame:
    """Centre and span of the points' box; a span has a least width and is then shrunk."""
    box = df.agg(F.min(lng).alias("w"), F.max(lng).alias("e"), F.min(lat).alias("s"), F.max(lat).alias("n"))
    span = lambda a, b: F.round(F.greatest(F.col(b) - F.col(a), F.lit(least)) * shrink, 6)
    return box.select(F.round((F.col("w") + F.col("e")) / 2, 6).alias("lng"), F.round((F.col("s") + F.col("n")) / 2, 6).alias("lat"), span("w", "e").alias("span_lng"), span("s", "n").alias("span_lat"))


def polygon_box(df: DataFrame, key: str, rings: str) -> DataFrame:
    """The box of a polygon's rings."""
    flat = df.select(key, F.explode(rings).alias("r")).select(key, F.explode("r").alias("p"))
    return flat.groupBy(key).agg(F.min(F.col("p")[0]).alias("w"), F.min(F.col("p")[1]).alias("s"), F.max(F.col("p")[0]).alias("e"), F.max(F.col("p")[1]).alias("n"))


def add_stages(df: DataFrame, key: str, year: str, stage: str, stages: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums over a single and its composite stage, by year."""
    return df.filter(F.col(stage).isin(*stages)).groupBy(key, year).agg(*[F.sum(v).alias(v) for v in values])


def year_range(df: DataFrame, key: str, year: str) -> DataFrame:
    """A36: "first-last", or the one year."""
    lo, hi = F.min(year), F.max(year)
    return df.groupBy(*cols(key)).agg(F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit("-"), hi.cast("string"))).alias("years"))
