"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors of length one with cosine c lie at squared distance 2 - 2c. A fixed random rotation spreads that distance evenly
and the rotated vector is cut into blocks of about ``BLOCK`` coordinates. If the whole squared distance is within the
budget, some block's is within its share, so a range join per block finds every pair: a grid over a block's leading
coordinates, of cells as wide as the ball, takes each vector to its own cell and to the cells that its ball touches.
Each entry of a cell carries the rotated vector at a byte a coordinate, whose distances are off by a known error at most;
inside a cell, pairs that may be within the whole budget become candidates. Three steps:

1. Cells report candidates as a spanning forest, never as all pairs. A cell with over ``CELL_CAP`` entries becomes one
   candidate star, so a bucket of cells is read as a stream that holds a bounded part of each cell.
2. The forest's components (distributed, see components.py) are the candidate clusters; their union over all blocks
   holds every pair within the budget.
3. Each cluster's vectors meet and all of their pairs are verified by cosine in double precision, in pieces of
   ``PIECE`` vectors, two pieces a task. Tasks report links of each vector as a number, and a spanning forest of links.

Equal vectors of one label fold into one node with a count, so copies are never paired. Vectors that are null, empty,
zero, or hold null or non-finite components, and those without a label, link with nothing. Vectors of different length
are never linked. Rows whose vec_id is null take part; a component's id is its smallest id that isn't null. Rows that
repeat are copies; a cosine that equals the threshold links. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import mix
from tessera.llm.components import connected_components, star_forest
from tessera.llm.store import dealt, stored

BLOCK = 8
#: Vectors of one label in a cell that the grid aims at.
CELL_ROWS = 2_000
#: A cell with more entries is taken as a whole to be a candidate cluster.
CELL_CAP = 32_768
#: Vectors of a cluster that meet in one task are at most two pieces.
PIECE = 2_048
SEED = 11
#: Room for rounding in single precision; candidates are verified in double.
SLACK = 1e-5
BUCKET_ROWS = 4_000
#: Steps of a sketch's coordinate.
STEPS = 127


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int) -> np.ndarray:
    return np.linspace(0, dim, max(1, dim // BLOCK) + 1).astype(int)


def grid_width(vectors: int) -> int:
    """Leading coordinates of a block that the grid cuts, by the vectors of the largest label: each leaves about a quarter of them in a cell and doubles the entries."""
    return min(BLOCK, 1 + math.ceil(max(0.0, math.log(max(1, vectors) / 4 / CELL_ROWS, 4))))


def _cells(threshold: float, buckets: int, grid: int):
    """mapInArrow function over (node, label, vector): per block the home cell and the cells in reach, with the vector's sketch, packed by bucket and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
            values, offsets = np.asarray(batch.column(2).flatten(), np.float64), np.diff(np.asarray(batch.column(2).offsets))
            begin = np.concatenate(([0], np.cumsum(offsets)))
            for dim in np.unique(offsets):
                rows = np.flatnonzero(offsets == dim)
                x = values[begin[rows][:, None] + np.arange(dim)]
                x /= np.linalg.norm(x, axis=1)[:, None]
                x = x @ rotation(int(dim))
                sketch = np.rint(x * STEPS).astype(np.int8)
                edges = block_edges(int(dim))
                share = np.diff(edges) / dim
                found: list[tuple[np.ndarray, ...]] = []
                for j in range(len(share)):
                    reach = np.sqrt((2 - 2 * threshold) * share[j]) + SLACK
                    lead = x[:, edges[j] : edges[j + 1]][:, :grid]
                    base = mix(label[rows].view(np.uint64) * np.uint64(1_000_003) + np.uint64(j * 4096 + int(dim)))
                    low, high = np.floor((lead - reach) / (2 * reach)).astype(np.int64), np.floor((lead + reach) / (2 * reach)).astype(np.int64)
                    own = np.floor(lead / (2 * reach)).astype(np.int64)
                    other = np.where(low < own, low, high)  # a ball is as wide as a cell, so it touches two of them at most
                    for corner in product((0, 1), repeat=lead.shape[1]):
                        take = np.array(corner, bool)
                        touched = ~((other == own) & take).any(axis=1)
                        found.append((_cell(base, np.where(take, other, own))[touched], np.full(touched.sum(), take.any(), np.uint8), np.flatnonzero(touched)))
                key, role, row = (np.concatenate([f[k] for f in found]) for k in range(3))
                bucket = (key % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for b in np.flatnonzero(np.diff(cut)):
                    p = order[cut[b] : cut[b + 1]]
                    out.append((int(b), int(dim), key[p].tobytes(), role[p].tobytes(), node[rows[row[p]]].tobytes(), sketch[row[p]].tobytes()))
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(6)], names=["bucket", "dim", "keys", "roles", "nodes", "sketches"])

    return run


def _cell(base: np.ndarray, cell: np.ndarray) -> np.ndarray:
    h = base
    for k in range(cell.shape[1]):
        h = mix(h * np.uint64(31) + cell[:, k].view(np.uint64))
    return h


class _Cell:
    """What a task holds of one cell: its own vectors and those that reach into it."""

    def __init__(self, dim: int, cap: int):
        self.cap = cap
        self.nodes: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.sketches: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.held, self.dim, self.star = 0, dim, -1

    def add(self, role: int, nodes: np.ndarray, sketches: np.ndarray) -> np.ndarray | None:
        """Null, or once the cell has over ``cap`` entries and is a star, nodes that are all linked to ``star``."""
        if self.star < 0:
            self.nodes[role].append(nodes)
            self.sketches[role].append(sketches)
            self.held += len(nodes)
            if self.held <= self.cap:
                return None
            nodes = np.concatenate([*self.nodes[0], *self.nodes[1]])
            self.star = int(nodes.min())
            self.nodes, self.sketches = ([], []), ([], [])
        return nodes

    def pairs(self, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates: own vectors and all of the cell's whose sketches are near."""
        if self.star >= 0 or not self.nodes[0]:
            return
        home, near = np.concatenate(self.nodes[0]), np.concatenate([*self.nodes[0], *self.nodes[1]])
        x = np.concatenate(self.sketches[0]).astype(np.float32)
        y = np.concatenate([x, *(k.astype(np.float32) for k in self.sketches[1])])
        budget = (reach * STEPS) ** 2
        size = (y**2).sum(axis=1)
        for k in range(0, len(home), 512):
            part = x[k : k + 512]
            gap = (part**2).sum(axis=1)[:, None] + size - 2 * part @ y.T
            i, j = np.nonzero(gap <= budget)
            other = home[k + i] != near[j]
            yield home[k + i[other]], near[j[other]]


def _range_join(threshold: float, cap: int):
    """applyInArrow function over a bucket of cells: candidates as stars (a, b). Rows are read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, _Cell] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def keep(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal held, count
            held.append((a, b))
            count += len(a)
            if count > 1 << 20:
                held = [star_forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))]
                count = len(held[0][0])

        for batch in batches:
            for dim, k, r, v, p in zip(*(batch.column(c).to_pylist() for c in ("dim", "keys", "roles", "nodes", "sketches")), strict=True):
                key, role, node = np.frombuffer(k, np.uint64), np.frombuffer(r, np.uint8), np.frombuffer(v, np.int64)
                sketch = np.frombuffer(p, np.int8).reshape(len(key), dim)
                order = np.lexsort((role, key))
                new = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (role[order][1:] != role[order][:-1])))
                for s, e in zip(new.tolist(), np.append(new[1:], len(order)).tolist(), strict=True):
                    own = order[s:e]
                    cell = cells.setdefault(int(key[own[0]]), _Cell(dim, cap))
                    members = cell.add(int(role[own[0]]), node[own], sketch[own])
                    if members is not None:
                        keep(members, np.full(len(members), cell.star))
        for cell in cells.values():
            # each sketch is off by half a step a coordinate at most
            for a, b in cell.pairs(math.sqrt(2 - 2 * threshold) + math.sqrt(cell.dim) / STEPS + SLACK):
                keep(a, b)
        if held:
            a, b = star_forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _verify(threshold: float):
    """applyInArrow function over two pieces of a cluster, or one, or a bucket of whole clusters: of each node how many rows it is linked to, and stars of links."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.append_column("size", pa.compute.list_value_length(table["vector"]))
        table = table.sort_by([("cluster", "ascending"), ("piece", "ascending"), ("size", "ascending"), ("node", "ascending")])
        cluster, piece, node, copies = (np.asarray(table[c]) for c in ("cluster", "piece", "node", "copies"))
        sizes = np.asarray(table["size"])
        values = np.asarray(table["vector"].combine_chunks().flatten(), np.float64)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        out_n, stars = np.zeros(len(node), np.int64), []
        edge = np.flatnonzero(np.concatenate(([True], (cluster[1:] != cluster[:-1]) | (sizes[1:] != sizes[:-1]) | (piece[1:] != piece[:-1]))))
        parts = list(zip(edge.tolist(), np.append(edge[1:], len(node)).tolist(), strict=True))
        two = table["two_pieces"][0].as_py()
        for k, (s, e) in enumerate(parts):
            dim = int(sizes[s])
            # one piece meets itself; of two, each meets the other; parts of one cluster and piece differ in length only
            others = [p for p in parts[k + 1 :] if sizes[p[0]] == dim and piece[p[0]] != piece[s]] if two else [(s, e)]
            x = values[begin[s] : begin[e]].reshape(-1, dim)
            norm = np.sqrt((x**2).sum(axis=1))
            for t, f in others:
                y = x if t == s else values[begin[t] : begin[f]].reshape(-1, dim)
                other = norm if t == s else np.sqrt((y**2).sum(axis=1))
                near = (x @ y.T) / (norm[:, None] * other) >= threshold
                if t == s:
                    np.fill_diagonal(near, False)
                out_n[s:e] += near @ copies[t:f]
                if t != s:
                    out_n[t:f] += near.T @ copies[s:e]
                i, j = np.nonzero(near)
                if len(i):
                    stars.append(star_forest(node[s + i], node[t + j]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in stars)]) for k in (0, 1))
        linked = out_n > 0
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.concat_tables([
            pa.table([pa.array(node[linked]), pa.array(out_n[linked]), none(int(linked.sum())), none(int(linked.sum()))], names=["node", "n", "a", "b"]),
            pa.table([none(len(a)), none(len(a)), pa.array(a), pa.array(b)], names=["node", "n", "a", "b"]),
        ])

    return run


def usable(vector: str) -> Column:
    """Whether a vector can be compared: not null, zero or empty, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cell_cap: int = CELL_CAP, piece: int = PIECE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. The caps change who compares which vectors, never the result."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("usable", usable("vector") & F.col("label").isNotNull())
    rows = rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "vector")))
    rows = rows.withColumn("vector", F.when(F.col("usable"), F.col("vector")))
    rows = stored(rows, "vectors")
    nodes = rows.filter("usable").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"))
    nodes = stored(nodes, "vector-nodes")
    count, largest = nodes.groupBy("label").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    floor = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(floor, count // BUCKET_ROWS)
    cells = nodes.select("node", "label", "vector").mapInArrow(_cells(threshold, buckets, grid_width(largest)), "bucket int, dim int, keys binary, roles binary, nodes binary, sketches binary")
    near = dealt(cells, buckets).groupBy("bucket").applyInArrow(_range_join(threshold, cell_cap), "a long, b long")
    clusters = connected_components(near, "a", "b").withColumnRenamed("component", "cluster")
    clusters = clusters.union(clusters.select("cluster", "cluster").distinct())
    members = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    placed = stored(clusters.join(members, "cluster").join(nodes, "node"), "vector-clusters")
    facts = ("cluster", "node", "copies", "vector")
    small = placed.filter(F.col("members") <= piece).select(F.pmod(F.xxhash64("cluster"), F.lit(buckets)).cast("int").alias("bucket"), *facts, F.lit(0).alias("piece"), F.lit(False).alias("two_pieces"))
    schema = "node long, n long, a long, b long"
    found = dealt(small, buckets).groupBy("bucket").applyInArrow(_verify(threshold), schema)
    pieces = F.ceil(F.col("members") / piece).cast("int")
    large = placed.filter(F.col("members") > piece).withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int"))
    met = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.select("cluster", F.least("piece", "other").alias("lower"), F.greatest("piece", "other").alias("upper"), "node", "copies", "vector", "piece", (F.col("piece") != F.col("other")).alias("two_pieces"))
    found = stored(found.union(met.groupBy("cluster", "lower", "upper").applyInArrow(_verify(threshold), schema)), "vector-links")
    degree = found.filter("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    linked = connected_components(found.filter("a is not null"), "a", "b")
    linked = linked.union(linked.select("component", "component").distinct())
    own = nodes.select("node", "copies")
    facts = own.join(degree, "node", "left").join(linked, "node", "left")
    facts = facts.select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = rows.select("vec_id", "node").join(facts, "node", "left")
    least = named.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    component = F.coalesce("least", "vec_id")
    return named.join(least, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
