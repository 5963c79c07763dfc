"""Vectorised scanning of Arrow string columns: bytes, words, word hashes, n-gram hashes.

A column's UTF-8 buffer is used as it is, a chunk of about a megabyte at a time, so memory stays bounded by the
longest single text. Hashes are 64-bit polynomial sums over random byte values, mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
# Freed Arrow buffers go back to the system at once; a worker shares its executor's memory with another one.
pa.set_memory_pool(pa.system_memory_pool())
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_U = np.uint64
_rng = np.random.RandomState(20240517)
BYTE_VALUE = _rng.randint(1, 1 << 62, size=256, dtype=np.int64).astype(_U) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_powers = {"p": np.ones(1, _U), "i": np.ones(1, _U)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def release() -> None:
    """Gives freed memory back to the system (glibc keeps it otherwise): workers are reused, and several share an executor's memory."""
    if _trim is not None:
        _trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, CHUNK * 2)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            full = np.full(size, base, _U)
            full[0] = 1
            _powers[key] = np.multiply.accumulate(full)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = off[:-1], off[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return raw, starts, ends


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, buffer, starts, ends): the rows' texts in a fresh buffer, one space after each."""
    raw, starts, ends = string_parts(column)
    lengths = ends - starts
    first = 0
    while first < len(starts):
        total = np.cumsum(lengths[first:] + 1)
        stop = first + max(1, int(np.searchsorted(total, size, "right")))
        part = lengths[first:stop]
        at = np.zeros(len(part) + 1, np.int64)
        np.cumsum(part + 1, out=at[1:])
        buf = np.full(int(at[-1]), 0x20, np.uint8)
        for k in range(len(part)):
            buf[at[k] : at[k] + part[k]] = raw[starts[first + k] : ends[first + k]]
        yield first, stop, buf, at[:-1], at[:-1] + part
        first = stop
    release()


class Words:
    """Words of a chunk: ``doc`` (row in the chunk), ``start``, ``end`` and 64-bit ``hash`` of each, in text order."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, letters: np.ndarray, lower: bool = True):
        edge = np.diff(np.concatenate(([False], letters[buf], [False])).view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(starts, self.start, "right") - 1
        p, _ = powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, _U)
        np.cumsum(BYTE_VALUE[LOWER[buf] if lower else buf] * p[: len(buf)], out=sums[1:])
        self.sums = sums
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inv = powers(len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inv[start])


_GRAM = mix(np.arange(1, 65, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)


def hash_bytes(word: bytes) -> int:
    """The hash that Words gives the same bytes."""
    buf = np.frombuffer(word, np.uint8)
    p, _ = powers(len(buf) + 1)
    return int(mix(np.array([(BYTE_VALUE[buf] * p[: len(buf)]).sum(dtype=_U)], _U))[0])


def gram_hashes(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all n consecutive words of one document, in order."""
    if len(hashes) < n:
        return doc[:0], hashes[:0]
    last = len(hashes) - n + 1
    total = hashes[:last] * _GRAM[0]
    for k in range(1, n):
        total += hashes[k : k + last] * _GRAM[k]
    whole = doc[:last] == doc[n - 1 :]
    return doc[:last][whole], mix(total[whole])


def sequence_hash(hashes: np.ndarray) -> int:
    """A hash of a short whole sequence of words; its length takes part, so it never equals that of a full gram by design."""
    total = (hashes * _GRAM[: len(hashes)]).sum(dtype=_U)
    return int(mix(np.array([total ^ _U(0xA5A5_5A5A_0000_0000 + len(hashes))], _U))[0])
