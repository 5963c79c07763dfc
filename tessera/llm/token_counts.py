"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, by a byte-level BPE. Its tokens' byte spans are joined with the spans of its
sections (the lines of a text, or the fields that a record is put together from), and each token counts for the section
that holds it. A token that crosses a boundary goes by ``rule``:

- ``start``: to the section of its first byte;
- ``end``: to the section of its last byte;
- ``majority``: to the section with most of its bytes, the earliest of equals;
- ``share``: to each section by the share of its bytes (counts are then fractions).

Sections' counts always add up to the document's. A newline belongs to the line that it ends; a separator between fields
belongs to the field before it. Null and empty texts have no tokens and no sections; repeated rows are counted each.
Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import text_batches

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "majority", "share")
_made: dict[int, tuple] = {}


def read_ranks(path: str = VOCABULARY_FILE) -> dict[bytes, int]:
    """The vocabulary's ranks, read on the driver; tasks get them by broadcast and need no file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _encoding(ranks: dict[bytes, int]):
    """(encoding, byte length by token), made once in each Python process."""
    import tiktoken

    if id(ranks) not in _made:
        _made.clear()
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        _made[id(ranks)] = (tiktoken.Encoding("tessera", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length, ranks)
    return _made[id(ranks)][:2]


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(count of each section, number of tokens that cross a boundary) for spans that tile the same bytes from 0.

    Empty sections count nothing.
    """
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = np.flatnonzero(first != last)
    home = (last if rule == "end" else first).copy()
    if rule in ("start", "end") or not len(crossing):
        return np.bincount(home, minlength=len(section_ends)).astype(float), len(crossing)
    counts = np.bincount(np.delete(home, crossing), minlength=len(section_ends)).astype(float)
    for k in crossing.tolist():
        own = np.arange(first[k], last[k] + 1)
        begin = np.concatenate(([0], section_ends))[own]
        held = np.minimum(section_ends[own], token_ends[k]) - np.maximum(begin, starts[k])
        if rule == "majority":
            counts[own[held.argmax()]] += 1
        else:
            counts[own] += held / (token_ends[k] - starts[k])
    return counts, len(crossing)


def line_ends(data: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def _counted(shared, rule: str, ends_at: int | None):
    """mapInArrow function over (key, text, ...): counts by section; section ends come from column ``ends_at`` or are the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length = _encoding(shared.value)
        for batch in batches:
            tokens, crossing, counts = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = (text or "").encode()
                ends = (line_ends(data) if data else np.zeros(0, np.int64)) if ends_at is None else np.array(batch.column(ends_at)[k].as_py(), np.int64)
                ids = encoding.encode_to_numpy(text, disallowed_special=()) if data else np.zeros(0, np.uint32)
                by, n = attribute(np.cumsum(length[ids]), ends, rule)
                tokens.append(len(ids))
                crossing.append(n)
                counts.append(by.tolist())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip((tokens, crossing, counts), kinds, strict=True))], names=["key", "n_tokens", "n_crossing", "counts"])

    return run


def _finish(out: DataFrame, key: str, rule: str, sections: str) -> DataFrame:
    counts = F.col("counts") if rule == "share" else F.col("counts").cast("array<long>")
    return out.select(F.col("key").alias(key), "n_tokens", F.size("counts").cast("long").alias("n_sections"), "n_crossing", counts.alias(sections))


def line_tokens(docs: DataFrame, path: str = VOCABULARY_FILE, rule: str = "majority", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, n_sections, n_crossing, section_tokens (tokens of each line)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = docs.schema[key].dataType.simpleString()
    out = text_batches(docs).select(F.col(key).alias("key"), text).mapInArrow(_counted(shared, rule, None), f"key {kind}, n_tokens long, n_crossing long, counts array<double>")
    return _finish(out, key, rule, "section_tokens")


def field_tokens(rows: DataFrame, fields: Sequence[str], key: str, path: str = VOCABULARY_FILE, rule: str = "majority", separator: str = "\n") -> DataFrame:
    """Per row: key, n_tokens, n_sections, n_crossing, field_tokens (tokens of each field) of the fields put together by the separator.

    A null field is empty; the separator after a field counts as part of it.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("" if f == fields[-1] else separator)) for f in fields]
    ends = F.array(*[sum((F.octet_length(p) for p in parts[1 : k + 1]), F.octet_length(parts[0])) for k in range(len(parts))])
    kind = rows.schema[key].dataType.simpleString()
    out = text_batches(rows).select(F.col(key).alias("key"), F.concat(*parts).alias("whole"), ends.alias("ends")).mapInArrow(_counted(shared, rule, 2), f"key {kind}, n_tokens long, n_crossing long, counts array<double>")
    return _finish(out, key, rule, "field_tokens")
