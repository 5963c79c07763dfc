"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Items are split into words (A-Z lower-cased, other ASCII non-alphanumerics separate). The automaton of all items is
built once on the driver from at most ``MAX_ITEM_BYTES`` of item text; a larger benchmark is dealt over several
automata by a hash of its text and the documents pass through one after the other, so what is broadcast stays bounded.
Documents stream through it word by word; the longest match ending at each word tells which words are hit.

A word outside the items' vocabulary always resets the automaton, and a run of known words shorter than the shortest
window cannot hold one, so only the other runs are stepped through in Python; the rest is vectorised.

Null or empty texts have no words and are never hit. Items without words are ignored. An item whose id is null still
marks words but is not listed among the items. Repeated rows are judged one by one; repeated items and equal windows of
several items all count. A very long text is judged whole, a task holds some 50 bytes for each of its bytes. Other
columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytescan import ALNUM, LOWER, Words, chunks
from tessera.llm.store import fresh, text_batches

WINDOW = 10
#: Item text that one automaton may hold: some 300 MB on the driver while it is built, less in a worker; more goes to further passes.
MAX_ITEM_BYTES = 8 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over integer words; ``windows`` numbers the sets of items whose windows end in a state.

    Nearly all states have one transition; it stands in two arrays, and dictionaries hold the others'. A state takes some
    40 bytes. Words are below 2^31.
    """

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.word, self.next = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.windows = array("i", [-1]) * len(self.length)
        self.sets: list[frozenset[str]] = []
        numbers: dict[frozenset[str], int] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for name, words in items:
            if not words:
                continue
            own = frozenset([name] if name is not None else [])
            state, matched = 0, 0
            for w in words:
                state, matched = self.step(state, matched, w)
                if matched >= window:
                    at = self.window_state(state)
                    held = self.windows[at]
                    if held < 0 or not own <= self.sets[held]:
                        both = own if held < 0 else own | self.sets[held]
                        if both not in numbers:
                            numbers[both] = len(self.sets)
                            self.sets.append(both)
                        self.windows[at] = numbers[both]
            if len(words) < window:
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                self.short.setdefault(state, []).append((len(words), name))
        self.shortest = min([window, *(n for entries in self.short.values() for n, _ in entries)])
        #: the nearest state at or above each one, by suffix links, at which a short item ends
        self.short_at = array("i", [-1]) * len(self.length)
        if self.short:
            for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist():
                self.short_at[s] = s if s in self.short else self.short_at[self.link[s]] if s else -1

    def get(self, state: int, w: int) -> int:
        """The state that a word leads to, -1 for none."""
        if self.word[state] == w:
            return self.next[state]
        others = self.more.get(state)
        return others.get(w, -1) if others is not None else -1

    def _set(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.next[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _extend(self, last: int, w: int) -> int:
        q = self.get(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and self.get(p, w) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.get(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def _state(self, length: int) -> int:
        for column, value in ((self.word, -1), (self.next, -1), (self.link, 0), (self.length, length)):
            column.append(value)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.word[copy], self.next[copy] = self.word[q], self.next[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.get(p, w) == q:
            self._set(p, w, copy)
            p = self.link[p]
        return copy

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """The state and length of the longest match that ends in w."""
        while (to := self.get(state, w)) < 0:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return to, matched + 1

    def window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit spans of word positions, items found) of one run of known words."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state, matched = 0, 0
        for at, w in enumerate(words, 1):
            state, matched = self.step(state, matched, w)
            covered = 0
            if matched >= self.window:
                covered = matched
                found |= self.sets[self.windows[self.window_state(state)]]
            end = self.short_at[state]
            while end >= 0:
                for n, name in self.short[end]:
                    if n <= matched:
                        covered = max(covered, n)
                        if name is not None:
                            found.add(name)
                end = self.short_at[self.link[end]] if end else -1
            if covered:
                while spans and spans[-1][0] >= at - covered:
                    spans.pop()
                if spans and spans[-1][1] >= at - covered:
                    spans[-1] = (spans[-1][0], at)
                else:
                    spans.append((at - covered, at))
        return spans, found


class Screen:
    """An automaton with its vocabulary of word hashes."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        hashes: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(items)
        for first, stop, buf, starts, _ in chunks(texts):
            words = Words(buf, starts, ALNUM)
            cuts = np.searchsorted(words.doc, np.arange(stop - first + 1))
            hashes[first:stop] = [words.hash[a:b] for a, b in pairwise(cuts)]
        self.vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        coded = [np.searchsorted(self.vocabulary, h).tolist() for h in hashes]
        self.automaton = SuffixAutomaton([(name, c) for (name, _), c in zip(items, coded, strict=True)], window)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def runs(self, doc: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, int]]:
        """Spans of consecutive known words of one document that are long enough for a window."""
        if len(code):
            cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | ((code[1:] < 0) != (code[:-1] < 0)))))
            end = np.append(cut[1:], len(code))
            keep = (code[cut] >= 0) & (end - cut >= self.automaton.shortest)
            yield from zip(cut[keep].tolist(), end[keep].tolist(), strict=True)


def _screened(screen: Screen, text_at: int, first_pass: bool):
    """mapInArrow function: appends n_words, hit words (packed int64 positions) and items to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words = np.zeros(n, np.int64)
            hits: list[list[np.ndarray]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            for first, stop, buf, starts, _ in chunks(batch.column(text_at)):
                words = Words(buf, starts, ALNUM)
                begin = np.searchsorted(words.doc, np.arange(stop - first + 1))
                n_words[first:stop] = np.diff(begin)
                code = screen.known(words.hash)
                for a, b in screen.runs(words.doc, code):
                    spans, found = screen.automaton.scan(code[a:b].tolist())
                    if spans:
                        row = int(words.doc[a])
                        hits[first + row] += [np.arange(a + x, a + y) - begin[row] for x, y in spans]
                        items[first + row] |= found
            keep = batch.columns
            if not first_pass:
                old_hits, old_items = (c.to_pylist() for c in keep[-2:])
                keep = keep[:-3]
                for k in range(n):
                    hits[k].append(np.frombuffer(old_hits[k], np.int64))
                    items[k] |= set(old_items[k])
            packed = [np.unique(np.concatenate(h)).astype(np.int64).tobytes() if h else b"" for h in hits]
            made = [pa.array(n_words), pa.array(packed, pa.binary()), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*keep, *made], names=[str(k) for k in range(len(keep) + 3)])

    return run


HIT_FIELDS = [
    T.StructField("_n_words", T.LongType()),
    T.StructField("_hit_words", T.BinaryType()),
    T.StructField("_item_ids", T.ArrayType(T.StringType())),
]


def screen_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """All columns of docs plus ``_n_words``, ``_hit_words`` (packed int64 word positions) and ``_item_ids``, named anew if docs has those. No shuffle of documents."""
    source = items.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).cast("string").alias("words"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    passes = max(1, -(-total // max_item_bytes))
    fields = list(docs.schema.fields)
    added = [T.StructField(fresh(f.name, docs.columns), f.dataType) for f in HIT_FIELDS]
    out = text_batches(docs)
    for k in range(passes):
        part = source if passes == 1 else source.filter(F.pmod(F.xxhash64("words"), F.lit(passes)) == k)
        screen = Screen([(r.name, r.words) for r in part.orderBy("name", "words").collect()], window)
        out = out.mapInArrow(_screened(screen, docs.columns.index(text), k == 0), T.StructType([*fields, *added]))
    return out


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    seen = screen_documents(docs.select("doc_id", "text"), items, **options)
    n_hit = (F.octet_length("_hit_words") / 8).cast("long")
    return seen.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_item_ids"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_words(text: str, hit: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of each run of hit words."""
    data = np.frombuffer(text.encode(), np.uint8)
    edge = np.diff(np.concatenate(([False], ALNUM[LOWER[data]], [False])).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.flatnonzero(np.diff(hit) > 1)
    keep = np.ones(len(data), bool)
    for a, b in zip(hit[np.append(0, cuts + 1)], hit[np.append(cuts, len(hit) - 1)], strict=True):
        keep[start[a] : end[b]] = False
    return data[keep].tobytes().decode()


def _cut(n_columns: int, text_at: int, max_coverage: float, max_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = batch.column(text_at).to_pylist(), np.ones(batch.num_rows, bool)
            n_words = np.asarray(batch.column(n_columns))
            for k, packed in enumerate(batch.column(n_columns + 1).to_pylist()):
                if packed:
                    hit = np.frombuffer(packed, np.int64)
                    run_length = int(np.diff(np.concatenate(([-1], np.flatnonzero(np.diff(hit) > 1), [len(hit) - 1]))).max())
                    if len(hit) > max_coverage * n_words[k] or run_length > max_run:
                        kept[k] = False
                    else:
                        texts[k] = cut_words(texts[k], hit)
            columns = [c if k != text_at else pa.array(texts, pa.string()) for k, c in enumerate(batch.columns[:n_columns])]
            yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(n_columns)]).filter(pa.array(kept))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = 0.5, max_run: int = 1 << 40, **options) -> DataFrame:
    """Documents without the hit spans; one hit in over ``max_coverage`` of its words or over ``max_run`` words in a row goes whole.

    Other documents, also those without any word, stay as they are; columns are those of docs.
    """
    seen = screen_documents(docs, items, text=text, **options)
    n = len(docs.columns)
    return seen.mapInArrow(_cut(n, docs.columns.index(text), max_coverage, max_run), docs.schema)


def brute_force_row(text: str | None, items: list[tuple[str | None, str]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """Reference for tests: (n_words, n_hit, n_items, items_sha256) of one text by comparing every window."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for name, t in items:
        own = split(t)
        n = min(window, len(own))
        for a in range(len(own) - n + 1) if own else ():
            for b in range(len(words) - n + 1):
                if words[b : b + n] == own[a : a + n]:
                    hit.update(range(b, b + n))
                    if name is not None:
                        found.add(name)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
