"""Connected components on DataFrames by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import release
from tessera.llm.store import Stored


#: Links that one task may finish by itself: 32 MB of them.
LOCAL_LINKS = 1 << 21


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars: (node, smallest node of its component) of all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hooking to minima and pointer jumping, vectorised
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a task's links by stars, folding whenever LOCAL_LINKS have come together: as connected, fewer rows."""
    held, count = [], 0
    for batch in batches:
        held.append(tuple(np.asarray(batch.column(k)) for k in (0, 1)))
        count += batch.num_rows
        if count > LOCAL_LINKS:
            held = [star_forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))]
            count = 0
    if held:
        u, v = star_forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        for k in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], names=["u", "v"])
    held = []
    release()


def connected_components(links: DataFrame, a: str, b: str, local_links: int = LOCAL_LINKS) -> DataFrame:
    """Returns (node, component): the smallest node that each linked node can reach. Nodes without a link to another are absent.

    Each task first folds its own links. While more than ``local_links`` are left, large-star and small-star steps follow
    (minima are partial aggregates, and adaptive execution splits the hot keys of the joins); each is written to the
    shared folder. What fits one task is finished there.
    """
    spark = links.sparkSession
    start = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    now = Stored(start.mapInArrow(local_forest, "u long, v long"), "links")
    before = None
    while True:
        state = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= local_links:
            done = Stored(now.df.coalesce(1).mapInArrow(local_forest, "u long, v long"), "components")
            now.drop()
            return done.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if state == before:
            return spark.read.parquet(now.path).select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        both = now.df.union(now.df.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mid = Stored(large.filter("u <> v").distinct(), "large-star")
        down = mid.df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.union(low.select("u", F.col("m").alias("v")))
        after = Stored(small.distinct(), "small-star")
        now.drop()
        mid.drop()
        now = after
