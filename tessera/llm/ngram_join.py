"""N-gram Jaccard self-join by R-trees over count vectors, and its connected components.

A document is its set of distinct word n-grams, hashed to 64 bits; texts with equal sets fold into one node. The n-grams
fall by hash into ``GROUPS`` groups, and the group counts of a set are a point. The sum of the coordinates' minima of
two points bounds the overlap of the sets from above, and the same with the upper corners of two boxes bounds it for all
pairs of two tree nodes: that is what the R-tree join prunes by. Pairs of points that it leaves are bounded once more by
finer groups, about one for each 8 n-grams; what is left is verified on the n-gram hashes.

One tree over all documents can't be split by space (a single coordinate bounds nothing: the whole difference of two
sets may lie in one group), so the trees are dealt by a key that no linked pair can miss: of the sets' hashes in one
fixed order (widespread n-grams last), two linked sets share one among the first n - ceil(t * n) + 1. The documents of
one such n-gram form one tree; of their first shared n-gram more is known: sets of its tree are near in size, and it is
among the first n - ceil(2 t n / (1 + t)) + 1 of the smaller one. Sets of an n-gram without such a partner leave its tree;
what is left becomes trees of sets whose sizes are near. Three steps:

1. The trees report which nodes may be linked, as a spanning forest and never as all pairs.
2. Its components are the candidate clusters (distributed, see components.py).
3. Each cluster's sets meet once, in one more tree, and pairs that aren't connected yet are verified on all 64 bits of
   their hashes. A cluster of over ``CLUSTER_CAP`` nodes is verified in pieces instead: first each piece, together with
   the cluster's ``HUBS`` hub sets, then what is not in the largest component so found, against everything.

Null, empty and wordless texts have no n-grams and are linked with nothing. With fewer than n words the whole sequence
is the only n-gram. Rows of one doc_id with different texts count as different nodes with the same id. Rows whose
doc_id is null take part; a component's id is its smallest id that isn't null. Rows that repeat are copies; a similarity
that equals the threshold links. A very long text is one set; a task holds some 50 bytes for each of its bytes. Other
columns pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import NOT_SPACE, Words, chunks, gram_hashes, mix, release, sequence_hash
from tessera.llm.components import connected_components
from tessera.llm.store import Stored, buckets_for, dealt, stored, text_batches

#: Groups of the trees' count vectors, and the most of a stored one: a set of n n-grams has about n / 8 groups, since
#: with many more n-grams than groups the counts of all sets are alike and bound nothing.
GROUPS = 64
MOST_GROUPS = 4096
LEAF = 32
FAN = 16
#: Nodes that one verifying task may hold.
CLUSTER_CAP = 20_000
#: Nodes of one tree of step 1. The sets of an n-gram that are more, though near in size, are mostly large groups of near
#: copies; they become one candidate cluster, and step 3's tree prunes its pairs once. With few nodes a tree, n-grams that
#: unlike documents share grow past it with the corpus, and their clusters join to one of half of all documents.
TREE_CAP = 2_048
#: Nodes of one row that names such a cluster.
ROW_CAP = 4_096
#: Sets of a large cluster that each of its pieces is compared with first.
HUBS = 64
#: N-grams of a bucket that a task holds before it folds those that widespread n-grams don't need.
HELD = 1 << 22
#: An n-gram goes last in the order if it is in over one document of so many (and in over 50).
WIDE = 2_000


def ngram_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each row that has words."""
    for first, stop, buf, starts, _ in chunks(column):
        words = Words(buf, starts, NOT_SPACE)
        row, gram = gram_hashes(words.hash, words.doc, n)
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        row, gram = row[new], gram[new]
        cut = np.searchsorted(row, np.arange(stop - first + 1))
        begin = np.searchsorted(words.doc, np.arange(stop - first + 1))
        for k in range(stop - first):
            if cut[k] < cut[k + 1]:
                yield first + k, gram[cut[k] : cut[k + 1]]
            elif begin[k] < begin[k + 1]:
                yield first + k, np.array([sequence_hash(words.hash[begin[k] : begin[k + 1]])], np.uint64)


def set_node(grams: np.ndarray) -> int:
    """A set's fingerprint as a signed 64-bit number."""
    total = mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def group_number(sizes: np.ndarray) -> np.ndarray:
    """Groups of sets of those sizes: powers of two."""
    wanted = np.maximum(np.asarray(sizes, np.int64), 8) / 8
    return np.clip(1 << np.ceil(np.log2(wanted)).astype(np.int64), GROUPS, MOST_GROUPS)


def group_counts(grams: np.ndarray) -> np.ndarray:
    """One byte a group, or two or four where a count needs them. The first half of the groups plus the second are the counts over half as many."""
    groups = int(group_number(np.array([len(grams)]))[0])
    counts = np.bincount((grams >> np.uint64(20)).astype(np.int64) % groups, minlength=groups)
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


class Points:
    """Count vectors of sets: ``coarse`` over GROUPS groups for the trees, and as fine as stored for a tighter bound of a pair."""

    def __init__(self, rows: list[bytes], sizes: np.ndarray):
        self.sizes = np.asarray(sizes)
        self.groups = group_number(self.sizes)
        self.place = np.zeros(len(rows), np.int64)
        self.fine: dict[int, np.ndarray] = {}
        for groups in np.unique(self.groups).tolist():
            own = np.flatnonzero(self.groups == groups)
            self.place[own] = np.arange(len(own))
            counts = [np.frombuffer(rows[k], f"u{len(rows[k]) // groups}") for k in own.tolist()]
            self.fine[groups] = np.stack(counts).astype(max(c.dtype for c in counts), copy=False)
        self.coarse = self._coarse(np.arange(len(rows)))

    def _coarse(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), GROUPS), np.uint32)
        for groups, held in self.fine.items():
            own = np.flatnonzero(self.groups[rows] == groups)
            for k in range(0, len(own), 1 << 12):
                part = own[k : k + (1 << 12)]
                out[part] = _folded(held[self.place[rows[part]]], GROUPS)
        return out.astype(np.uint16) if not len(out) or out.max() < 1 << 16 else out

    def take(self, rows: np.ndarray) -> Points:
        out = object.__new__(Points)
        out.sizes, out.groups, out.place, out.fine, out.coarse = self.sizes[rows], self.groups[rows], self.place[rows], self.fine, self.coarse[rows]
        return out

    def near(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Share of the two sizes that two sets can have in common at most, for pairs that may be linked by it, else -1."""
        out = np.full(len(i), -1.0)
        kinds = self.groups[i] * (2 * MOST_GROUPS) + self.groups[j]
        for kind in np.unique(kinds).tolist():
            a, b = divmod(kind, 2 * MOST_GROUPS)
            least = min(a, b)
            own = np.flatnonzero(kinds == kind)
            step = max(1, (1 << 20) // least)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                x, y = (_folded(self.fine[g][self.place[rows[part]]], least) for g, rows in ((a, i), (b, j)))
                overlap = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                total = self.sizes[i[part]] + self.sizes[j[part]]
                out[part] = np.where((100 + percent) * overlap >= percent * total, overlap / total, -1.0)
        return out


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    if counts.shape[1] == groups:
        return counts
    return counts.reshape(len(counts), -1, groups).sum(axis=1, dtype=np.uint32)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


NODE_SCHEMA = "doc_id long, text_hash long, node long, n_grams long, counts binary, wide binary"


def _nodes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        docs, kept, sizes = 0, [], []
        for batch in batches:
            rows = batch.num_rows
            node, size = [None] * rows, [0] * rows
            counts = [None] * rows
            for row, hashes in ngram_sets(batch.column(1), n):
                node[row], size[row] = set_node(hashes), len(hashes)
                if node[row] not in seen:
                    seen.add(node[row])
                    counts[row] = group_counts(hashes).tobytes()
                    kept.append(hashes)
            docs += rows
            sizes.append(rows)
            if sum(map(len, kept)) > 1 << 19:
                kept = [_often(kept, docs)]
            columns = [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(counts, pa.binary()), pa.nulls(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "n_grams", "counts", "wide"])
        often = _often(kept, docs)
        if len(often):
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([often.tobytes()], pa.binary())], names=["doc_id", "text_hash", "node", "n_grams", "counts", "wide"])

    return run


def _grams(n: int):
    """mapInArrow function over (node, cluster, members, text): each node once, with its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node = batch.column(0).to_pylist()
            at, counts, grams = [], [], []
            new = [k for k, v in enumerate(node) if v not in seen and not seen.add(v)]
            for k, hashes in ngram_sets(batch.column(3).take(pa.array(new, pa.int64())), n):
                if set_node(hashes) == node[new[k]]:  # another text may have the same hash
                    at.append(new[k])
                    counts.append(group_counts(hashes).tobytes())
                    grams.append(hashes.tobytes())
            held = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:3]]
            sizes = pa.array([len(g) // 8 for g in grams], pa.int64())
            yield pa.RecordBatch.from_arrays([*held, sizes, pa.array(counts, pa.binary()), pa.array(grams, pa.binary())], names=["node", "cluster", "members", "n_grams", "counts", "grams"])

    return run


def _often(kept: list[np.ndarray], docs: int) -> np.ndarray:
    """N-grams, repeated as often as they were seen, of those that are in enough of a task's documents to be widespread."""
    if not kept:
        return np.zeros(0, np.uint64)
    values, count = np.unique(np.concatenate(kept), return_counts=True)
    many = count > max(2, docs // (2 * WIDE))
    return np.repeat(values[many], count[many])


def _count_wide(key: tuple, table: pa.Table) -> pa.Table:
    values, count = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in table["wide"].to_pylist()]), return_counts=True)
    return pa.table({"gram": pa.array(values.view(np.int64)), "n": pa.array(count)})


def wide_grams(nodes: DataFrame, docs: int) -> np.ndarray:
    """Sorted n-grams that go last: those seen in over 1 of WIDE documents. The counts sum to the n-grams seen, so there are at most WIDE times the mean n-grams a document; only efficiency depends on them."""
    per_task = nodes.filter("wide is not null").select("wide").mapInArrow(_split_wide, "bucket int, wide binary")
    total = per_task.groupBy("bucket").applyInArrow(_count_wide, "gram long, n long")
    rows = total.filter(F.col("n") > max(50, docs // WIDE)).select("gram").toArrow()
    return np.sort(np.asarray(rows["gram"].combine_chunks()).view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def _split_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            grams = np.frombuffer(data, np.uint64)
            bucket = (grams % np.uint64(16)).astype(np.int64)
            parts = [(k, grams[bucket == k].tobytes()) for k in range(16)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["bucket", "wide"])


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def short_prefix(size: int, percent: int) -> int:
    """Of the smaller one of two linked sets, the n-grams that hold the first shared one: so many must be left from it on."""
    return size - -(-2 * percent * size // (100 + percent)) + 1


def partners(gram: np.ndarray, size: np.ndarray, short: np.ndarray, percent: int) -> np.ndarray:
    """Which (n-gram's number, set) have another set near in size with which the n-gram can be the first shared one; ``short``: it is in the set's short prefix."""
    size = size.astype(np.int64)
    base = gram.astype(np.int64) << 32
    key, low = base + size, base + -(-percent * size // 100)
    high = base + np.minimum(100 * size // max(percent, 1), (1 << 32) - 1)
    every, shorts = np.sort(key), np.sort(key[short])
    as_larger = np.searchsorted(shorts, key, "right") - np.searchsorted(shorts, low, "left") - short
    as_smaller = np.searchsorted(every, high, "right") - np.searchsorted(every, key, "left") - 1
    return (as_larger > 0) | (short & (as_smaller > 0))


def _prefixes(n: int, percent: int, wide: np.ndarray, buckets: int):
    """mapInArrow function: (bucket, grams, owners, nodes, sizes, shorts): prefix n-grams by bucket, owners index the nodes of the row, shorts are bits: in the short prefix."""

    def flush(grams: list[np.ndarray], nodes: list[int], n_grams: list[int]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat, owner = np.concatenate(grams), np.repeat(np.arange(len(grams), dtype=np.int32), sizes)
        shorts = np.array([short_prefix(v, percent) for v in n_grams])
        short = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < shorts[owner]
        n_of = np.array(n_grams, np.int32)
        bucket = (mix(flat) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        node = np.array(nodes, np.int64)
        rows = []
        for k in np.flatnonzero(cut[1:] > cut[:-1]):
            part = order[cut[k] : cut[k + 1]]
            used, local = np.unique(owner[part], return_inverse=True)
            rows.append((int(k), flat[part].tobytes(), local.astype(np.int32).tobytes(), node[used].tobytes(), n_of[used].tobytes(), np.packbits(short[part]).tobytes()))
        names = ["bucket", "grams", "owners", "nodes", "sizes", "shorts"]
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        grams: list[np.ndarray] = []
        nodes: list[int] = []
        sizes: list[int] = []
        held = 0
        for batch in batches:
            for _, hashes in ngram_sets(batch.column(0), n):
                node = set_node(hashes)
                if node in seen:
                    continue
                seen.add(node)
                take = prefix_length(len(hashes), percent)
                if len(wide):
                    at = np.minimum(np.searchsorted(wide, hashes), len(wide) - 1)
                    last = wide[at] == hashes
                    hashes = np.concatenate([hashes[~last], hashes[last]])
                grams.append(hashes[:take])
                nodes.append(node)
                sizes.append(len(hashes))
                held += take
                if held > 1 << 19:
                    yield flush(grams, nodes, sizes)
                    grams, nodes, sizes, held = [], [], [], 0
        if grams:
            yield flush(grams, nodes, sizes)
        grams = []
        release()

    return run


def _block_rows(rows: list[tuple[bool, np.ndarray]]) -> pa.RecordBatch:
    names = [int(mix(v.view(np.uint64) ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64).view(np.int64)) for _, v in rows]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([w for w, _ in rows], pa.bool_()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.int64()))], names=["block", "whole", "nodes"])


def size_parts(gram: np.ndarray, size: np.ndarray, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, part of each) of (n-gram, set) in order of n-gram and size: in parts of which any two near sizes of an n-gram share one.

    Parts end where sizes have a gap. Those of over ``most`` places become overlapping ones, of two classes of sizes each.
    """
    new = np.append(True, (gram[1:] != gram[:-1]) | (100 * size[:-1] < percent * size[1:]))[: len(gram)]
    part = np.cumsum(new) - 1
    width = np.bincount(part, minlength=1)
    large = width[part] > most
    bounds = [1]  # of classes: two sizes that are near are in one class or in neighbours
    while len(size) and percent and bounds[-1] <= int(size.max()):
        bounds.append(max(bounds[-1] + 1, 100 * bounds[-1] // percent + 1))
    kind = np.searchsorted(np.array(bounds), size, "right")
    at = np.flatnonzero(large)
    span = len(bounds) + 2
    places = np.concatenate([np.flatnonzero(~large), at, at])
    key = np.concatenate([part[~large] * span, part[at] * span + kind[at], part[at] * span + kind[at] + 1])
    return places, key


def _blocks(cap: int, held_most: int = HELD, percent: int = 100):
    """applyInArrow function over a bucket: the distinct node sets (two nodes or more) of its n-grams; wide ones are whole clusters, their first node in each row.

    Rows are read as a stream; of an n-gram with over ``cap`` nodes only the first one is held once a task holds
    ``held_most`` n-grams. When all have been read, nodes without a partner go, and the rest is parted by size. Rows
    without sizes count as of one size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, node, kind = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # kind: twice the size, and one more in the short prefix
        more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        wide = np.zeros(0, np.uint64)
        rows: list[tuple[bool, np.ndarray]] = []

        def sort() -> None:
            nonlocal gram, node, kind
            gram, node, kind = (np.concatenate([v, *(m[k] for m in more)]) for k, v in enumerate((gram, node, kind)))
            more.clear()
            order = np.lexsort((node, gram))
            gram, node, kind = gram[order], node[order], kind[order]
            new = np.append(True, (gram[1:] != gram[:-1]) | (node[1:] != node[:-1]))[: len(gram)]
            gram, node, kind = gram[new], node[new], kind[new]

        def stars(part: np.ndarray, node: np.ndarray, large: np.ndarray) -> np.ndarray:
            """Turns parts of the sorted places to rows, those marked; returns which places go."""
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            gone = np.zeros(len(part), bool)
            for a, n in zip(first[large].tolist(), np.diff(np.append(first, len(part)))[large].tolist(), strict=True):
                for k in range(a + 1, a + n, ROW_CAP):
                    rows.append((True, np.concatenate([node[a : a + 1], node[k : min(k + ROW_CAP, a + n)]])))
                gone[a + 1 : a + n] = True
            return gone

        def fold(most: int) -> None:
            """Sorts what is held; n-grams with over ``most`` nodes turn to rows."""
            nonlocal gram, node, kind, wide
            sort()
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
            size = np.diff(np.append(first, len(gram)))
            large = (size > most) | np.isin(gram[first], wide) if len(first) else np.zeros(0, bool)
            gone = stars(gram, node, large)
            wide = np.union1d(wide, gram[first[large]])
            gram, node, kind = gram[~gone], node[~gone], kind[~gone]

        count = 0
        for batch in batches:
            sized = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in ("sizes", "shorts")]
            for g, o, v, s, b in zip(*(batch.column(c).to_pylist() for c in ("grams", "owners", "nodes")), *sized, strict=True):
                owner = np.frombuffer(o, np.int32)
                own = np.full(len(owner), 3) if s is None else 2 * np.frombuffer(s, np.int32).astype(np.int64)[owner] + np.unpackbits(np.frombuffer(b, np.uint8), count=len(owner))
                more.append((np.frombuffer(g, np.uint64), np.frombuffer(v, np.int64)[owner], own))
                count += len(more[-1][0])
            if count > held_most:
                fold(cap)
                count = len(gram) // 2  # so that a bucket of rare n-grams isn't folded for each batch
                if rows:
                    yield _block_rows(rows)
                    rows = []
        fold(1 << 62)  # the rest of n-grams that are rows already
        number = np.cumsum(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
        stay = partners(number, kind >> 1, (kind & 1).astype(bool), percent)
        gram, node, size = number[stay], node[stay], kind[stay] >> 1
        order = np.lexsort((size, gram))
        places, part = size_parts(gram[order], size[order], percent, cap)
        node = node[order][places]
        order = np.lexsort((node, part))
        part, node = part[order], node[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        gone = stars(part, node, np.diff(np.append(first, len(part))) > cap)
        part, node = part[~gone], node[~gone]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        last = np.append(first[1:], len(part))[: len(first)]
        blocks: dict[bytes, np.ndarray] = {}
        for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
            blocks.setdefault(node[a:b].tobytes(), node[a:b])
        rows += [(False, v) for v in blocks.values()]
        for k in range(0, len(rows), 10_000):
            yield _block_rows(rows[k : k + 10_000])
        del gram, node, kind, number, size, part, places, order, rows, blocks
        release()

    return run


class CountTree:
    """Packed R-tree over count vectors: boxes' upper corners and size ranges, level by level from the leaves up."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = np.concatenate([*self._split(counts, np.argsort(sizes, kind="stable"), sizes), np.zeros(0, np.int64)]).astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, low_n, high_n = counts[self.order], sizes[self.order], sizes[self.order]
        width = LEAF
        while True:
            cut = np.arange(0, len(low_n), width)
            high, low_n, high_n = np.maximum.reduceat(high, cut), np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut)
            self.levels.append((high, low_n, high_n))
            if len(cut) == 1:
                return
            width = FAN

    def _split(self, counts: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Halves by size while sizes differ by more than the threshold allows, else by the widest coordinate; pieces are multiples of a leaf."""
        if len(rows) <= LEAF:
            yield rows
            return
        own = counts[rows].astype(np.int32)
        spread = own.max(axis=0) - own.min(axis=0)
        key = sizes[rows] if sizes[rows].min() < 0.8 * sizes[rows].max() else own[:, spread.argmax()]
        half = max(LEAF, len(rows) // 2 // LEAF * LEAF)
        rows = rows[np.argsort(key, kind="stable")]
        yield from self._split(counts, rows[:half], sizes)
        yield from self._split(counts, rows[half:], sizes)


def may_link(overlap: np.ndarray, low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether some pair of sets of those sizes with at most that overlap can have Jaccard similarity of percent / 100."""
    low, high = np.maximum(low_a, low_b), np.minimum(high_a, high_b)
    return ((100 + percent) * overlap >= percent * (low_a + low_b)) & (100 * high >= percent * low)


class Groups:
    """Components of a growing forest: ``label[k]`` is the same for connected nodes."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: list[list[int]] = [[k] for k in range(n)]

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


def tree_pairs(counts: np.ndarray, sizes: np.ndarray, percent: int, labels: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of pairs of points that the bounds don't rule out and whose labels differ when their batch is made.

    Pairs within a leaf come first, as they are the likeliest links and spare the others.
    """
    if len(sizes) < 2:
        return
    tree = CountTree(counts, sizes)
    counts, sizes = counts[tree.order], sizes[tree.order]
    if counts.max() < 256:
        counts = counts.astype(np.uint8)
    padded = np.concatenate([counts, np.zeros((-len(counts) % LEAF, counts.shape[1]), counts.dtype)])
    a = b = np.zeros(1, np.int64)
    for depth in range(len(tree.levels) - 1, -1, -1):
        high, low_n, high_n = tree.levels[depth]
        if depth < len(tree.levels) - 1:
            a, b = ((x[:, None] * FAN + k).reshape(-1) for x, k in ((a, np.repeat(np.arange(FAN), FAN)), (b, np.tile(np.arange(FAN), FAN))))
            fits = (a <= b) & (b < len(low_n))
            a, b = a[fits], b[fits]
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 14):
            x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
            keep[k : k + (1 << 14)] = may_link(np.minimum(high[x], high[y]).sum(axis=1, dtype=np.int64), low_n[x], high_n[x], low_n[y], high_n[y], percent)
        a, b = a[keep], b[keep]
    order = np.argsort(a != b, kind="stable")
    a, b = a[order], b[order]
    lanes, cut = np.arange(LEAF), np.arange(0, len(sizes), LEAF)
    for k in range(0, len(a), 32):
        label = labels(tree.order)
        low, high = np.minimum.reduceat(label, cut), np.maximum.reduceat(label, cut)
        x, y = a[k : k + 32], b[k : k + 32]
        split = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
        x, y = x[split], y[split]
        i = (x[:, None, None] * LEAF + lanes[:, None] + 0 * lanes).reshape(-1)
        j = (y[:, None, None] * LEAF + lanes + 0 * lanes[:, None]).reshape(-1)
        fits = (i < j) & (j < len(sizes))
        i, j = np.minimum(i, len(sizes) - 1), np.minimum(j, len(sizes) - 1)
        fits &= (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])) & (label[i] != label[j])
        if 2 * fits.sum() > len(fits):  # whole leaves against each other need no copies of their rows
            both = [padded[z[:, None] * LEAF + lanes] for z in (x, y)]
            overlap = np.minimum(both[0][:, :, None], both[1][:, None]).sum(axis=-1, dtype=np.uint32).reshape(-1)[fits]
            i, j = i[fits], j[fits]
        else:
            i, j = i[fits], j[fits]
            overlap = np.minimum(counts[i], counts[j]).sum(axis=1, dtype=np.uint32)
        near = (100 + percent) * overlap.astype(np.int64) >= percent * (sizes[i] + sizes[j])
        if near.any():
            yield tree.order[i[near]], tree.order[j[near]]


def _points(table: pa.Table) -> Points:
    return Points(table["counts"].to_pylist(), np.asarray(table["n_grams"]))


def _forest(percent: int):
    """applyInArrow function over a bucket of trees: links that may hold, without those between nodes already connected here."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("node", "ascending")])
        block, node = np.asarray(table["block"]), np.asarray(table["node"])
        names, at = np.unique(node, return_inverse=True)
        first = np.zeros(len(names), np.int64)
        first[at[::-1]] = np.arange(len(node))[::-1]
        points = _points(table.take(pa.array(first)))  # of each node, by its place in ``names``
        counts, sizes = points.coarse, points.sizes
        cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        groups, out = Groups(len(names)), []
        width = np.diff(cut)
        two = cut[:-1][width == 2]
        pairs = np.unique(np.stack([at[two], at[two + 1]], axis=1), axis=0)
        for k in range(0, len(pairs), 1 << 14):
            i, j = pairs[k : k + (1 << 14), 0], pairs[k : k + (1 << 14), 1]
            near = may_link(np.minimum(counts[i], counts[j]).sum(axis=1, dtype=np.int64), sizes[i], sizes[i], sizes[j], sizes[j], percent)
            i, j = i[near], j[near]
            near = points.near(i, j, percent) >= 0
            out += [(x, y) for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True) if groups.join(x, y)]
        for s, e in zip(cut[:-1][width > 2], cut[1:][width > 2], strict=True):
            own = at[s:e]
            for i, j in tree_pairs(counts[own], sizes[own], percent, lambda rows, own=own: groups.label[own[rows]]):
                near = points.near(own[i], own[j], percent) >= 0
                out += [(x, y) for x, y in zip(own[i[near]].tolist(), own[j[near]].tolist(), strict=True) if groups.join(x, y)]
        made = pa.table({"a": pa.array(names[[x for x, _ in out]], pa.int64()), "b": pa.array(names[[y for _, y in out]], pa.int64())})
        del table, counts, points, groups, out
        release()
        return made

    return run


def verify(points: Points, grams: list[bytes], percent: int, known: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the true links among the given sets: pairs that the trees leave and a finer bound leaves are compared gram by gram.

    Sets of one ``known`` component count as connected from the start.
    """
    sizes = points.sizes
    groups, sets = Groups(len(sizes)), {}
    if known is not None:
        order = np.argsort(known, kind="stable")
        for x, y in pairwise(order.tolist()):
            if known[x] == known[y]:
                groups.join(x, y)
    for i, j in tree_pairs(points.coarse, sizes, percent, lambda rows: groups.label[rows]):
        near = points.near(i, j, percent)
        order = np.argsort(-near, kind="stable")[: int((near >= 0).sum())]  # the likeliest first
        i, j = i[order], j[order]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if groups.label[x] == groups.label[y]:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = unpack(grams[k])
            a, b = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            if 100 * both >= percent * (int(sizes[x]) + int(sizes[y]) - both) and groups.join(x, y):
                yield x, y


def _verify(percent: int, by: str, known: str | None = None):
    """applyInArrow function over a bucket of clusters, or over pieces: true links. Rows that repeat a node count once."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(by, "ascending"), ("node", "ascending")])
        groups, nodes = np.asarray(table[by]), np.asarray(table["node"])
        new = np.append(True, (groups[1:] != groups[:-1]) | (nodes[1:] != nodes[:-1]))[: len(nodes)]
        table = table.filter(pa.array(new))
        cluster, node = np.asarray(table[by]), np.asarray(table["node"])
        points = _points(table)
        grams = table["grams"].to_pylist()
        parts = np.asarray(table[known]) if known else None
        a, b = [], []
        for s, e in pairwise(np.append(np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])), len(cluster))):
            for x, y in verify(points.take(np.arange(s, e)), grams[s:e], percent, None if parts is None else parts[s:e]):
                a.append(node[s + x])
                b.append(node[s + y])
        del points, grams, table
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _in_pieces(large: DataFrame, percent: int, cluster_cap: int) -> DataFrame:
    """Links of clusters that are too large for one task: (a, b).

    A piece has half as many sets as a task may hold. First each piece is verified together with its cluster's hubs, the
    ``HUBS`` sets with the smallest hash. Of each cluster, the sets of the largest component found so far needn't be
    compared with each other any more: only pairs of pieces of which one holds other sets are left.
    """
    large = stored(large.dropDuplicates(["node"]), "ngram-large")
    half = cluster_cap // 2
    mixed = F.xxhash64("node", F.lit(1))
    pieces = F.ceil(F.col("members") / half).cast("int")
    own = large.withColumn("pieces", pieces).withColumn("piece", F.pmod(mixed, F.col("pieces")).cast("int"))
    # at least HUBS in expectation of each cluster, and about that many however large it is
    hub = F.pmod(F.xxhash64("node", F.lit(2)), F.greatest(F.ceil(F.col("members") / HUBS), F.lit(1))) == 0
    hubs = own.filter(hub).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = own.unionByName(hubs).dropDuplicates(["cluster", "piece", "node"]).withColumn("two", F.xxhash64("cluster", "piece"))
    first = stored(met.groupBy("two").applyInArrow(_verify(percent, "two"), "a long, b long"), "ngram-hub-links")
    parts = connected_components(first, "a", "b")
    parts = parts.union(parts.select("component", "component").distinct())
    own = own.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component", "piece", "pieces")
    sizes = own.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("n_main"))
    marked = own.join(main, "cluster").withColumn("rest", F.col("part") != F.col("main"))
    n_rest, n_main = F.ceil((F.col("members") - F.col("n_main")) / half).cast("int"), F.ceil(F.col("n_main") / half).cast("int")
    marked = marked.withColumn("n_rest", n_rest).withColumn("n_all", n_rest + n_main).filter("n_rest > 0")
    marked = marked.withColumn("piece", F.when(F.col("rest"), F.pmod(mixed, F.col("n_rest"))).otherwise(F.col("n_rest") + F.pmod(mixed, F.greatest(F.col("n_all") - F.col("n_rest"), F.lit(1)))).cast("int"))
    # pieces from 0 hold the rest, those from n_rest on the main component
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("n_all")).otherwise(F.col("n_rest")) - 1)).alias("other")
    two = marked.select("cluster", "node", "n_grams", "counts", "grams", "part", "piece", other)
    two = two.withColumn("two", F.xxhash64("cluster", F.least("piece", "other"), F.greatest("piece", "other")))
    return first.union(two.groupBy("two").applyInArrow(_verify(percent, "two", "part"), "a long, b long"))


def similar_nodes(docs: DataFrame, n: int, percent: int, cluster_cap: int = CLUSTER_CAP, tree_cap: int = TREE_CAP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node, n_grams of each row; node, component of nodes that are linked). The caps change who compares what, never the result."""
    docs = text_batches(docs)
    table = Stored(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_nodes(n), NODE_SCHEMA), "ngram-nodes")
    every = table.df.filter("wide is null")
    wide = wide_grams(table.df, every.count())
    buckets = buckets_for(docs, 8)
    prefixes = docs.select("text").mapInArrow(_prefixes(n, percent, wide, buckets), "bucket int, grams binary, owners binary, nodes binary, sizes binary, shorts binary")
    blocks = dealt(prefixes, buckets).groupBy("bucket").applyInArrow(_blocks(tree_cap, percent=percent), "block long, whole boolean, nodes array<long>")
    blocks = stored(blocks.dropDuplicates(["block"]), "ngram-blocks")
    docs_nodes = stored(every.select("doc_id", "text_hash", "node", "n_grams"), "ngram-docs")
    points = every.filter("counts is not null").groupBy("node").agg(F.first("n_grams").alias("n_grams"), F.first("counts").alias("counts"))
    stars = blocks.filter("whole").select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b"))
    members = blocks.filter("not whole").select("block", F.explode("nodes").alias("node"), F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int").alias("bucket"))
    forest = dealt(members.join(points, "node"), buckets).groupBy("bucket").applyInArrow(_forest(percent), "a long, b long")
    clusters = stored(connected_components(forest.union(stars), "a", "b").withColumnRenamed("component", "cluster"), "ngram-clusters")
    clusters = clusters.union(clusters.select(F.col("cluster"), F.col("cluster")).distinct())
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    texts = docs_nodes.groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    placed = stored(clusters.join(sizes, "cluster").join(texts, "node"), "ngram-members")
    few = placed.count() * 32 <= 32 << 20
    own = docs.select("text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(placed) if few else placed, "text_hash")
    # n-grams are made again for the nodes of clusters only, instead of stored for all
    joined = own.select("node", "cluster", "members", "text").mapInArrow(_grams(n), "node long, cluster long, members long, n_grams long, counts binary, grams binary")
    small = joined.filter(F.col("members") <= cluster_cap).withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(buckets)).cast("int"))
    links = dealt(small, buckets).groupBy("bucket").applyInArrow(_verify(percent, "cluster"), "a long, b long")
    if placed.filter(F.col("members") > cluster_cap).limit(1).count():
        links = links.union(_in_pieces(joined.filter(F.col("members") > cluster_cap), percent, cluster_cap))
    out = stored(connected_components(links, "a", "b"), "ngram-components")
    table.drop()
    return docs_nodes, out


def _components(docs: DataFrame, n: int, percent: int, **caps: int) -> DataFrame:
    """doc_id, text_hash, n_grams and component (a node; null without n-grams) of each row."""
    rows, linked = similar_nodes(docs, n, percent, **caps)
    linked = linked.union(linked.select("component", "component").distinct())
    return rows.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))


def similarity_components(docs: DataFrame, n: int = 4, percent: int = 85, **caps: int) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    named = _components(docs, n, percent, **caps)
    least = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select(
        "doc_id", F.col("n_grams").alias("n_shingles"), F.when(F.col("n_grams") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each component, once; columns are those of docs.

    Rows without words stay, all of them. Of a component's rows with the smallest id that differ, the one whose text has
    the smallest hash stays; a component without any id keeps one row as well.
    """
    named = _components(docs, n, percent).filter("component is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = named.groupBy("component").agg(first).select(F.col("first.no_id").alias("no_id"), F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.text_hash").alias("hash"))
    keys = ["no_id", "id", "hash"]
    own = docs.select(F.struct("*").alias("document"), "text", F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = own.filter(wordy).select("document", *keys).groupBy(*keys).agg(F.first("document").alias("document"))
    return once.join(stored(kept, "ngram-kept"), keys).select("document.*").union(own.filter(~wordy).select("document.*"))
