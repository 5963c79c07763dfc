"""Which of many names occur in some text of a corpus, by one scan of the texts for all names at once.

Names are grouped by the largest power of two in their byte length; a name's first so many bytes are its anchor. A
text's rolling hashes at that width find the anchors, the hashes of each whole length the names, and bytes decide.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of the names that one pass over the texts looks for; more names take further passes.
BLOCK = 16 << 20
#: Bytes of texts that are scanned at a time.
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.RandomState(7).randint(1, 1 << 62, size=256, dtype=np.int64).astype(_U) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    full = np.full(n, base, _U)
    full[:1] = 1
    return np.multiply.accumulate(full)


class _Hashes:
    """Hashes of all spans of a buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[buf] * _powers(_BASE, n), out=self.sums[1:])

    def spans(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at]


class _Set:
    """A set of hashes."""

    def __init__(self, hashes: Iterable[int]):
        self.sorted = np.unique(np.array(list(hashes), _U))
        self.flags = np.zeros(1 << 20, bool)
        self.flags[self.sorted >> _U(44)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of those that are in the set."""
        at = np.flatnonzero(self.flags[hashes >> _U(44)])
        some = hashes[at]
        return at[self.sorted[np.minimum(np.searchsorted(self.sorted, some), len(self.sorted) - 1)] == some]


class Names:
    def __init__(self, names: Iterable[bytes]):
        self.by_hash: dict[tuple[int, int], list[bytes]] = defaultdict(list)
        anchors, whole = defaultdict(set), defaultdict(set)
        for name in names:
            hashes = _Hashes(np.frombuffer(name, np.uint8))
            start, width = np.zeros(1, np.int64), 1 << len(name).bit_length() - 1
            h = int(hashes.spans(start, len(name))[0])
            anchors[width].add(int(hashes.spans(start, width)[0]))
            whole[len(name)].add(h)
            self.by_hash[len(name), h].append(name)
        self.anchors = {w: _Set(h) for w, h in anchors.items()}
        self.whole = {n: np.array(sorted(h), _U) for n, h in whole.items()}

    def found(self, data: bytes, known: set[bytes]) -> Iterator[bytes]:
        """Names in the data that aren't known yet."""
        buf = np.frombuffer(data, np.uint8)
        hashes = _Hashes(buf)
        for width, anchors in self.anchors.items():
            if len(buf) < width:
                continue
            at = anchors.among(hashes.spans(np.arange(len(buf) - width + 1), width))
            for length in (n for n in self.whole if width <= n < 2 * width):
                here = at[at + length <= len(buf)]
                h = hashes.spans(here, length)
                hit = np.isin(h, self.whole[length])
                values, first = np.unique(h[hit], return_index=True)
                for value, start in zip(values.tolist(), here[hit][first].tolist(), strict=True):
                    for name in self.by_hash[length, value]:
                        # spans of one hash may differ, then the first is not all there is
                        if name not in known and (data[start : start + length] == name or name in data):
                            yield name


def _scan(names: Names, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()

        def look(texts: list[bytes]) -> pa.RecordBatch:
            new = set(names.found(b"\xff".join(texts), known))  # no UTF-8 text holds that byte
            known.update(new)
            return pa.RecordBatch.from_arrays([pa.array([n.decode() for n in new], pa.string())], names=[column])

        for batch in batches:
            texts, held = [], 0
            for text in batch.column(0):
                if text.is_valid:
                    texts.append(text.as_py().encode())
                    held += len(texts[-1])
                if held > CHUNK:
                    yield look(texts)
                    texts, held = [], 0
            yield look(texts)

    return run


def _blocks(names: DataFrame) -> Iterator[list[bytes]]:
    block, held = [], 0
    for row in names.toLocalIterator():
        block.append(row[0].encode())
        held += len(block[-1])
        if held > BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def occurring(names: DataFrame, name: str, corpus: DataFrame, text: str) -> DataFrame:
    """The distinct names (not null) that some text holds; an empty name is in every text."""
    distinct = names.select(name).filter(f"`{name}` is not null").distinct()
    texts = corpus.select(text).filter(f"`{text}` is not null")
    out = distinct.filter(f"`{name}` = ''").join(texts.limit(1).select(), how="cross")
    for block in _blocks(distinct.filter(f"`{name}` <> ''")):
        out = out.unionByName(texts.mapInArrow(_scan(Names(block), name), f"`{name}` string"))
    return out.distinct()
