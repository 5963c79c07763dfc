"""Removal of byte strings that repeat, by a distributed merge sort of suffixes that is aware of common prefixes.

A string of ``LENGTH`` bytes is removed wherever it starts if it starts anywhere else too. Sorting every suffix would move
many times the input, so the suffixes that start at anchors stand for all: the anchor of a window of LENGTH bytes is the
start of its ``SEED_BYTES``-gram with the smallest hash, the leftmost of equals. Equal windows have their anchor at the
same offset, so no repeat is missed, and each window belongs to one anchor.

1. Anchors meet by their gram's hash; those whose gram occurs once in all texts can't belong to a repeat and go.
2. The remaining suffixes, with the few bytes to their left that their windows need, are sorted in each task and
   exchanged as front-coded runs: of each suffix only what follows its common prefix with the one before.
3. The runs of one bucket of grams are merged by a loser tree that compares suffixes by the known lengths of their
   common prefixes and looks at bytes beyond those only. The merge yields the common prefix of neighbours, and with it
   which windows agree from the anchor on; equal bytes before the anchor complete the match.
4. Suffixes of a gram with over ``HOT`` places (a passage in very many different texts) would all meet in one task. Their
   windows are counted by hash instead, spread over all buckets.

Anchors are read as a stream, so a task holds one of each gram. Texts are identified by a 64-bit hash, in step 4 windows
as well; equal texts are sorted once, and a text of LENGTH bytes or more with a copy goes whole. Null and empty texts
have no bytes and lose none. Matches never cross documents. Repeated rows are copies. A very long text is one row of a
task, which holds some 50 bytes for each of its bytes. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import BYTE_VALUE, chunks, mix, powers, release
from tessera.llm.store import Stored, buckets_for, dealt, stored, text_batches

LENGTH = 200
SEED_BYTES = 80
#: Places of one gram whose suffixes one task merges; grams with more, and with a millionth of all places, are hot.
HOT = 20_000
#: Anchors that a task holds before it folds them.
HELD = 1 << 20
_U = np.uint64


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, place in the buffer, hash, least and most offset of the anchor in its windows) of a chunk's anchors."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(buf) - seed + 1
    if n <= 0:
        return none
    p, inv = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, _U)
    np.cumsum(BYTE_VALUE[buf] * p[: len(buf)], out=sums[1:])
    grams = mix((sums[seed:] - sums[:n]) * inv[:n])
    low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    width, size = length - seed + 1, 1
    while size < width:
        step = min(size, width - size)
        if len(low) <= step:
            return none
        low = np.minimum(low[:-step], low[step:])
        size += step
    first = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(starts, ends, strict=True) if e - s >= length] or [np.zeros(0, np.int64)])
    if not len(first):
        return none
    at = (low[first] & _U(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(starts, first, "right") - 1
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
    last = np.append(new[1:], len(at)) - 1
    return row[new], at[new], grams[at[new]], at[new] - first[last], at[new] - first[new]


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    names, cut = np.unique(bucket[order], return_index=True)
    ends = np.append(cut[1:], len(order))[: len(names)]
    arrays = [pa.array(names.astype(np.int32))]
    for values in columns.values():
        values = values[order]
        arrays.append(pa.array([values[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def _emit_anchors(length: int, seed: int, buckets: int):
    """mapInArrow function over (tid, text)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, tid, at, low, high = (np.concatenate([h[k] for h in held]) for k in range(5))
        bucket = (gram % _U(buckets)).astype(np.int64)
        return _packed(bucket, {"gram": gram, "tid": tid, "at": at.astype(np.int32), "low": low.astype(np.uint8), "high": high.astype(np.uint8)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()
        for batch in batches:
            tids = np.asarray(batch.column(0))
            fresh = np.zeros(len(tids), bool)
            for k, t in enumerate(tids.tolist()):
                if t not in seen:
                    fresh[k] = True
                    seen.add(t)
            for first, _, buf, starts, ends in chunks(batch.column(1)):
                ends = np.where(fresh[first : first + len(ends)], ends, starts)
                row, place, gram, low, high = anchors(buf, starts, ends, length, seed)
                if len(row):
                    held.append((gram, tids[first + row], place - starts[row], low, high))
                    count += len(row)
            if count > 1 << 20:
                yield flush(held)
                held, count = [], 0
        if held:
            yield flush(held)
        held = []
        release()

    return run


KINDS = {"gram": np.uint64, "tid": np.int64, "at": np.int32, "low": np.uint8, "high": np.uint8}
REPEATED = "tid long, places binary, gram long, n long"


def _by_text(tid: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(tid, kind="stable")
    places = np.zeros(len(tid), PLACE)
    places["at"], places["low"], places["high"] = at[order], low[order], high[order]
    names, cut = np.unique(tid[order], return_index=True)
    ends = np.append(cut[1:], len(tid))[: len(names)]
    packed = pa.array([places[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), packed, pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.int64())], names=["tid", "places", "gram", "n"])


class Repeats:
    """Entries (hash, text, place, ...) whose hash occurs at two places or more, out of a stream; one entry of each hash is held."""

    def __init__(self, held_most: int = HELD):
        self.held = [np.zeros(0, k) for k in (*KINDS.values(), np.int64, bool)]  # hash ... high, places of the hash, whether it is out
        self.more: list[list[np.ndarray]] = []
        self.count, self.held_most = 0, held_most

    def add(self, columns: list[np.ndarray]) -> bool:
        """Whether it is time to fold."""
        self.more.append([*columns, np.ones(len(columns[0]), np.int64), np.zeros(len(columns[0]), bool)])
        self.count += len(columns[0])
        return self.count > self.held_most

    def fold(self) -> tuple[np.ndarray, ...]:
        """(text, place, low, high) of entries that are known to repeat since the last time."""
        columns = [np.concatenate([h, *(m[k] for m in self.more)]) for k, h in enumerate(self.held)]
        self.more, self.count = [], 0
        gram, tid, at, _, _, _, out = columns
        order = np.lexsort((~out, at, tid, gram))
        gram, tid, at = gram[order], tid[order], at[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (tid[1:] != tid[:-1]) | (at[1:] != at[:-1]))[: len(gram)]
        gram, tid, at, low, high, n, out = (c[order][new] for c in columns)
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
        if not len(first):
            return tid, at, low, high
        size = np.diff(np.append(first, len(gram)))
        known = np.logical_or.reduceat(out, first) | (size > 1)
        go = np.repeat(known, size) & ~out
        self.held = [c[first] for c in (gram, tid, at, low, high)] + [np.add.reduceat(n, first), known]
        return tid[go], at[go], low[go], high[go]


def _repeated(hot: int, held_most: int = HELD):
    """applyInArrow function over a bucket: anchors whose gram occurs at two places or more, by text, and grams of over ``hot`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Repeats(held_most)
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in KINDS), strict=True):
                if seen.add([np.frombuffer(b, kind) for b, kind in zip(row, KINDS.values(), strict=True)]):
                    yield _by_text(*seen.fold())
        yield _by_text(*seen.fold())
        many = seen.held[5] > hot
        if many.any():
            none = int(many.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), pa.array(seen.held[0][many].view(np.int64)), pa.array(seen.held[5][many])], names=["tid", "places", "gram", "n"])

    return run


PLACE = np.dtype([("at", "<i4"), ("low", "u1"), ("high", "u1")])
RUN = "bucket int, runs binary, gram binary, tid binary, at binary"


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes at least."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(common prefix with the one before, rest length, rests) of sorted strings."""
    shared = np.zeros(len(suffixes), np.int32)
    for k in range(1, len(suffixes)):
        shared[k] = common_prefix(suffixes[k - 1], suffixes[k], 0)
    rests = [s[h:] for s, h in zip(suffixes, shared.tolist(), strict=True)]
    return shared, np.array([len(r) for r in rests], np.int32), b"".join(rests)


class LoserTree:
    """Merges sorted front-coded runs. Each loser keeps its common prefix with the last winner; strings are compared beyond that only."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.text: list[bytes | None] = [None] * self.size
        self.shared = [0] * self.size
        self.losers = [-1] * self.size
        for k in range(len(runs)):
            self._advance(k)

    def _advance(self, k: int) -> None:
        """The next string of run k; its common prefix with the one before, which has just won, is what the code says."""
        self.shared[k], self.text[k] = next(self.runs[k], (0, None))

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's string comes before run b's; the loser's known prefix becomes the one with the winner."""
        x, y = self.text[a], self.text[b]
        if x is None or y is None:
            return y is None
        if self.shared[a] != self.shared[b]:
            return self.shared[a] > self.shared[b]  # the loser's prefix with the new winner is its own shorter one
        h = common_prefix(x, y, self.shared[a])
        wins = x[h:] <= y[h:]
        self.shared[b if wins else a] = h
        return wins

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._beats(a, b):
            self.losers[node] = b
            return a
        self.losers[node] = a
        return b

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(run, common prefix with the string before, string) in order."""
        winner = self._build(1)
        while (text := self.text[winner]) is not None:
            yield winner, self.shared[winner], text
            self._advance(winner)
            node = (winner + self.size) // 2
            while node:
                other = self.losers[node]
                if self._beats(other, winner):
                    self.losers[node], winner = winner, other
                node //= 2


def decoded(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    before, at = b"", 0
    for h, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:h] + rests[at : at + n]
        at += n
        yield h, before


def _hash_at(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings of that size at the given places."""
    p, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_VALUE[data] * p[: len(data)], out=sums[1:])
    return mix((sums[at + size] - sums[at]) * inv[at])


def _is_hot(data: bytes, places: np.ndarray, seed: int, hot: np.ndarray) -> np.ndarray:
    """Which places have a gram of the sorted ``hot`` ones."""
    if not len(hot):
        return np.zeros(len(places), bool)
    grams = _hash_at(np.frombuffer(data, np.uint8), places["at"].astype(np.int64), seed)
    return hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams


def _emit_runs(length: int, seed: int, buckets: int, hot: np.ndarray):
    """mapInArrow function over (tid, text, places), by bucket: sorted runs of the anchors' suffixes with their left contexts; of hot grams' anchors the hashes of all windows."""
    import pickle

    def flush(held: list[tuple[int, bytes, bytes, int, int, int, int]]) -> pa.RecordBatch:
        by: dict[int, list] = {}
        for record in held:
            by.setdefault(record[0], []).append(record)
        out = []
        for bucket, records in by.items():
            records.sort(key=lambda r: r[1])
            shared, lengths, rests = front_coded([r[1] for r in records])
            left = [r[2] for r in records]
            facts = (np.array([len(x) for x in left], np.uint8), b"".join(left), np.array([r[3] for r in records], np.int64), np.array([r[4] for r in records], np.int32), np.array([r[5] for r in records], np.uint8), np.array([r[6] for r in records], np.uint8))
            out.append((bucket, pickle.dumps((shared, lengths, rests, *facts))))
        none = pa.nulls(len(out), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([r for _, r in out], pa.binary()), none, none, none], names=["bucket", "runs", "gram", "tid", "at"])

    def flush_windows(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, tid, at = (np.concatenate([h[k] for h in held]) for k in range(3))
        made = _packed((gram % _U(buckets)).astype(np.int64), {"gram": gram, "tid": tid, "at": at.astype(np.int32)})
        return pa.RecordBatch.from_arrays([made.column(0), pa.nulls(made.num_rows, pa.binary()), *made.columns[1:]], names=["bucket", "runs", "gram", "tid", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows, count = [], [], 0
        for batch in batches:
            for tid, text, packed in zip(*(batch.column(k) for k in range(3)), strict=True):
                tid, data = tid.as_py(), text.as_py().encode()
                places = np.frombuffer(b"".join(packed.as_py()), PLACE)
                spread = _is_hot(data, places, seed, hot)
                for at, low, high in places[~spread].tolist():
                    gram = data[at : at + seed]
                    held.append((hash_bucket(gram, buckets), data[at : at + length - low], data[at - high : at], tid, at, low, high))
                if spread.any():
                    at = np.unique(np.concatenate([np.arange(a - high, a - low + 1) for a, low, high in places[spread].tolist()]))
                    windows.append((_hash_at(np.frombuffer(data, np.uint8), at, length), np.full(len(at), tid, np.int64), at))
                    count += len(at)
                if len(held) > 200_000:
                    yield flush(held)
                    held = []
                if count > 1 << 20:
                    yield flush_windows(windows)
                    windows, count = [], 0
        if held:
            yield flush(held)
        if windows:
            yield flush_windows(windows)

    return run


def hash_bucket(gram: bytes, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(gram, digest_size=8).digest(), "little") % buckets


def repeated_windows(shared: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, counted: np.ndarray, length: int, width: int) -> np.ndarray:
    """Which windows (suffix, offset of the anchor) equal another suffix's window at that offset.

    ``shared`` are the common prefixes of neighbours in sorted order, ``left[:, l]`` the byte l + 1 before the anchor.
    """
    out = np.zeros((len(shared), width), bool)
    before = np.zeros(len(shared), _U)
    for offset in range(width):
        if offset:
            before = mix(before * _U(0x100000001B3) + left[:, offset - 1].astype(_U) + _U(1))
        active = np.flatnonzero((low <= offset) & (offset <= high) & counted)
        if not len(active):
            continue
        group = np.cumsum(shared < length - offset).astype(_U)[active]
        key = mix(before[active] + group * _U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        out[active[order], offset] = np.append(False, same) | np.append(same, False)
    return out


def _spans(tid: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans packed by text."""
    order = np.lexsort((begin, tid))
    names, cut = np.unique(tid[order], return_index=True)
    spans = np.stack([begin[order], end[order]], axis=1).astype(np.int64)
    stops = np.append(cut[1:], len(order))[: len(names)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([merged(spans[a:b]).tobytes() for a, b in zip(cut, stops, strict=True)], pa.binary())], names=["tid", "spans"])


def _merge(length: int, seed: int):
    """applyInArrow function over a bucket: its runs are merged, windows of hot grams counted as they come; spans to remove, packed by text."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, seen = [], Repeats()
        for batch in batches:
            coded += [pickle.loads(r) for r in batch.column("runs").to_pylist() if r is not None]
            for gram, tid, at in zip(*(batch.column(c).to_pylist() for c in ("gram", "tid", "at")), strict=True):
                if gram is not None:
                    none = np.zeros(len(gram) // 8, np.uint8)
                    if seen.add([np.frombuffer(gram, np.uint64), np.frombuffer(tid, np.int64), np.frombuffer(at, np.int32), none, none]):
                        tids, places, _, _ = seen.fold()
                        yield _spans(tids, places, places + length)
        tids, places, _, _ = seen.fold()
        yield _spans(tids, places, places + length)
        if coded:
            yield merge_runs(coded)
        del coded, seen
        release()

    def merge_runs(coded: list[tuple]) -> pa.RecordBatch:
        start = np.concatenate(([0], np.cumsum([len(c[0]) for c in coded])))
        done = [0] * len(coded)
        order, shared = np.zeros(start[-1], np.int64), np.zeros(start[-1], np.int32)
        for k, (r, h, _) in enumerate(LoserTree([decoded(*c[:3]) for c in coded])):
            order[k], shared[k] = start[r] + done[r], h
            done[r] += 1
        if len(shared):
            shared[0] = 0
        tid, at, low, high = (np.concatenate([c[k] for c in coded])[order] for k in (5, 6, 7, 8))
        low, high = low.astype(np.int32), high.astype(np.int32)
        lengths = np.concatenate([c[3] for c in coded]).astype(np.int64)
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(c[4] for c in coded) + b"\0", np.uint8)
        width = length - seed + 1
        back = ends[:, None] - 1 - np.arange(width - 1)
        left = np.where(np.arange(width - 1) < lengths[:, None], raw[np.maximum(back, 0)], 0).astype(np.uint8)[order]
        twice = np.lexsort((at, tid))
        again = np.append(False, (tid[twice][1:] == tid[twice][:-1]) & (at[twice][1:] == at[twice][:-1]))
        counted = np.ones(len(tid), bool)
        counted[twice[again]] = False  # the same place of equal texts, sent by two tasks
        hit = repeated_windows(shared, left, low, high, counted, length, width)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        return _spans(tid[row], at[row] - last, at[row] - first + length)

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (begin, end) spans; spans that touch are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


ANCHORS = "bucket int, gram binary, tid binary, at binary, low binary, high binary"


def repeat_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES, hot_places: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(docs with their text's hash ``tid``; of each hash with anything to remove: copies and packed spans)."""
    named = text_batches(docs).withColumn("tid", F.xxhash64("text"))
    texts = named.filter(F.octet_length("text") >= length).select("tid", "text")
    buckets = buckets_for(docs, 6)
    found = texts.mapInArrow(_emit_anchors(length, seed, buckets), ANCHORS)
    places = Stored(dealt(found, buckets).groupBy("bucket").applyInArrow(_repeated(hot_places), REPEATED), "suffix-places")
    by_text = places.df.filter("tid is not null").groupBy("tid").agg(F.collect_list("places").alias("places"))
    # at most a million grams, as each has a millionth of what they have together
    counted = places.df.filter("gram is not null")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.sort(np.array([r.gram for r in counted.filter(F.col("n") > total // 1_000_000).select("gram").collect()], np.int64).view(_U))
    joined = texts.dropDuplicates(["tid"]).join(by_text, "tid").select("tid", "text", "places")
    runs = joined.mapInArrow(_emit_runs(length, seed, buckets, hot), RUN)
    spans = Stored(dealt(runs, buckets).groupBy("bucket").applyInArrow(_merge(length, seed), "tid long, spans binary"), "suffix-spans")
    copies = texts.groupBy("tid").agg(F.count("*").alias("copies")).filter("copies > 1")
    listed = spans.df.groupBy("tid").agg(F.collect_list("spans").alias("spans"))
    info = stored(listed.join(copies, "tid", "full_outer"), "suffix-info")
    places.drop()
    spans.drop()
    return named, info


def _cut(length: int, with_bytes: bool):
    """mapInArrow function over (doc_id, text, copies, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for text, copies, spans in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                data = (text.as_py() or "").encode()
                cuts = np.zeros((0, 2), np.int64)
                if (copies.as_py() or 0) > 1 and len(data) >= length:
                    cuts = np.array([[0, len(data)]])
                elif spans.is_valid:
                    cuts = merged(np.frombuffer(b"".join(spans.as_py()), np.int64).reshape(-1, 2))
                at = [0, *cuts.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
                made.append((len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], kinds[k]) for k in range(5))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES, with_bytes: bool = True, hot_places: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; a cut may split a character)."""
    named, info = repeat_spans(docs.select("doc_id", "text"), length, seed, hot_places)
    joined = named.join(info, "tid", "left").select("doc_id", "text", "copies", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = joined.mapInArrow(_cut(length, with_bytes), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_bytes else out.drop("kept")


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """Reference for tests: (n_bytes, n_removed, n_spans, kept_sha256) by counting every string of that length."""
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        kept = bytes(b for b, g in zip(d, gone[1:-1], strict=True) if not g)
        out.append((len(d), len(d) - len(kept), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
