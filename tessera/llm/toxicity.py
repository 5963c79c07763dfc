"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings of 4 to 8 bytes that labelled toxic documents hold far more often
than the others. Features of a document: densities of lexicon words (plain, disguised by digits or signs, within reach
of a second-person word, at most in 50 words), capitals, punctuation, digits, disguised words, lengths. Trees are
trained on features by a lexicon from the other half of the labelled rows, isotonic calibration on margins of trees from the other half.

At most ``MAX_ROWS`` labelled rows, those with the smallest hash of their id, train the model; one third of the ids
(crc32 of the id modulo 3 is 1) is held out. Only text is read to score. Every document is scored over its whole text.

Null and empty texts are scored by the same trees, from zeros. A document labelled twice is toxic if any label says so;
a null label or id does not train. Without labelled rows every score is 0; with labels of one class, or too few for any
term, trees without a lexicon score by the class's share. Repeated rows get equal scores, and each row that repeats a
labelled id trains. Equal margins share one calibrated value. A very long text is scored whole; a task holds some 100
bytes for each of its bytes. Other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import BoostedTrees, Isotonic
from tessera.llm.bytescan import LOWER, NOT_SPACE, Words, chunks, hash_bytes
from tessera.llm.store import Stored, fresh, text_batches

MAX_ROWS = 20_000
MAX_TERMS = 600
#: A term is in this share of the toxic documents at least (and in 3), so that words of a few copied texts stay out.
MIN_SHARE = 0.02
#: Log-odds of a strong term.
STRONG = 4.5
THRESHOLD = 0.7
#: Term lengths in bytes; 0 is the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8)
REACH, SPAN = 5, 50
#: Second-person words.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: Signs that stand for letters.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
_SIGN = np.zeros(256, np.uint8)
for _a, _b in DISGUISE.items():
    _SIGN[ord(_a)] = ord(_b)
_SECOND = np.sort(np.array([hash_bytes(w.encode()) for w in SECOND_PERSON], np.uint64))


def _isin(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def terms(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, indexes of the words that have it, hashes)."""
    for k in LENGTHS:
        own = np.arange(len(words.start)) if k == 0 else np.flatnonzero(words.end - words.start >= k)
        # a beginning and a whole word of the same bytes are different terms
        yield k, own, words.hash if k == 0 else words.span_hash(words.start[own], words.start[own] + k) ^ np.uint64(k)


class Lexicon:
    """Terms' hashes; ``strong`` are those hardly ever seen in documents that aren't toxic."""

    def __init__(self, hashes: list[int], strong: list[int]):
        self.hashes, self.strong = (np.sort(np.array(h, np.int64).view(np.uint64)) for h in (hashes, strong))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words have a term, and which a strong one."""
        some, strong = np.zeros(len(words.start), bool), np.zeros(len(words.start), bool)
        for _, own, h in terms(words):
            found = _isin(self.hashes, h)
            some[own[found]] = True
            strong[own[found][_isin(self.strong, h[found])]] = True
        return some, strong


def undisguised(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buffer with signs before letters turned to letters, mask of what stays): other signs inside words go, so words close up."""
    letter, sign = LETTERS[buf], _SIGN[buf] > 0
    after = np.append(letter[1:], False)
    after2 = np.append(after[1:], False)
    before = np.concatenate(([False], (letter | sign)[:-1]))
    turn = sign & before & (after | (np.append(sign[1:], False) & after2))
    out = np.where(turn, _SIGN[buf], buf)
    return out, letter | turn | ~NOT_SPACE[buf]


NAMES = (
    "log_words log_bytes strong_hits strong_density hits hits_log hit_density distinct_hits span_hits disguised_hits second_person near_second_person capitals shouting exclaim question commas stops other_signs digits disguised_words long_words high_bytes lines repeats"
).split()


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((len(column), len(NAMES)))
    for first, stop, buf, starts, ends in chunks(column):
        n = stop - first
        words = Words(buf, starts, LETTERS)
        doc, count = words.doc, np.bincount(words.doc, minlength=n).astype(float)
        per_word, size = np.maximum(count, 1), (ends - starts).astype(float)
        per_byte = np.maximum(size, 1)
        total = lambda mask: np.bincount(doc[mask], minlength=n).astype(float)
        sums = lambda mask: np.add.reduceat(np.append(mask, 0).astype(np.int64), starts)[:n].astype(float)
        hit, strong = lexicon.hits(words)
        you = _isin(_SECOND, words.hash)
        run = np.concatenate(([0], np.cumsum(you)))
        at = np.arange(len(doc))
        begin = np.searchsorted(doc, np.arange(n + 1))
        low, high = np.maximum(at - REACH, begin[doc]), np.minimum(at + REACH + 1, begin[doc + 1])
        near = hit & (run[high] > run[low])
        hits_run = np.concatenate(([0], np.cumsum(hit)))
        span = hits_run[np.minimum(at + SPAN, begin[doc + 1])] - hits_run[at]
        most = np.zeros(n)
        np.maximum.at(most, doc, span)
        pair = np.unique(np.stack([doc[hit], (words.hash[hit] >> np.uint64(1)).astype(np.int64)]), axis=1)
        clean, keep = undisguised(buf)
        closed = np.cumsum(keep) - keep
        plain = Words(clean[keep], closed[starts], LETTERS)
        token = Words(buf, starts, NOT_SPACE)
        inner = np.concatenate(([0], np.cumsum(~LETTERS[buf] & NOT_SPACE[buf])))
        length = token.end - token.start
        signs = inner[np.maximum(token.end - 1, token.start)] - inner[np.minimum(token.start + 1, token.end)]
        odd = (signs > 0) & (length > 3)
        shout = (words.end - words.start > 2) & (np.concatenate(([0], np.cumsum(UPPER[buf])))[words.end] - np.concatenate(([0], np.cumsum(UPPER[buf])))[words.start] == words.end - words.start)
        same = np.concatenate(([False], (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1]))) if len(doc) else np.zeros(0, bool)
        hits = total(hit)
        other = NOT_SPACE[buf] & ~LETTERS[buf] & ~((buf >= 48) & (buf <= 57)) & ~np.isin(buf, (33, 63, 44, 46))
        made = (
            np.log1p(count), np.log1p(size), total(strong), total(strong) / per_word, hits, np.log1p(hits), hits / per_word, np.bincount(pair[0], minlength=n), most,
            np.maximum(np.bincount(plain.doc[lexicon.hits(plain)[0]], minlength=n) - hits, 0), total(you) / per_word, total(near) / per_word,
            sums(UPPER[buf]) / per_byte, total(shout) / per_word, sums(buf == 33) / per_byte, sums(buf == 63) / per_byte, sums(buf == 44) / per_byte, sums(buf == 46) / per_byte,
            sums(other) / per_byte, sums((buf >= 48) & (buf <= 57)) / per_byte, np.bincount(token.doc[odd], minlength=n) / per_word, total(words.end - words.start > 14) / per_word,
            sums(buf >= 0x80) / per_byte, sums(buf == 10) / per_byte, total(same) / per_word,
        )
        out[first:stop] = np.stack(made, axis=1)
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(toxic, half, text) of the labelled rows that train, at most max_rows."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("half")
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("toxic", half, "text")


def _count_terms(known: np.ndarray | None):
    """mapInArrow function over (toxic, half, text): documents and occurrences of terms by class and half; ``known`` limits the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            toxic, half = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int64)
            for first, _, buf, starts, _ in chunks(batch.column(2)):
                words = Words(buf, starts, LETTERS)
                for _, own, h in terms(words):
                    if known is not None:
                        some = _isin(known, h)
                        own, h = own[some], h[some]
                    doc = words.doc[own] + first
                    order = np.lexsort((doc, h))
                    doc, h = doc[order], h[order]
                    cut = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, int)
                    times = np.diff(np.append(cut, len(h)))
                    parts.append((h[cut], half[doc[cut]] * 2 + toxic[doc[cut]], times))
        if parts:
            h, kind, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.lexsort((kind, h))
            h, kind, times = h[order], kind[order], times[order]
            cut = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (kind[1:] != kind[:-1]))) if len(h) else np.zeros(0, int)
            n = np.diff(np.append(cut, len(h)))
            uses = np.add.reduceat(times, cut) if len(cut) else times
            yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array(kind[cut]), pa.array(n), pa.array(uses)], names=["term", "kind", "docs", "uses"])

    return run


def learn_lexicons(rows: DataFrame, max_terms: int = MAX_TERMS) -> list[Lexicon]:
    """Lexicons of half 0, half 1 and both: terms in enough toxic documents (MIN_SHARE), by the log-odds of their use, above 2."""
    kinds = "term long, kind long, docs long, uses long"
    sizes = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    # no half can take a term of fewer documents; as a document has each term once, at most 1 / MIN_SHARE times a document's terms are left
    least = max(3, int(np.ceil(MIN_SHARE * min(sizes.get((h, 1), 0) for h in (0, 1)))))
    toxic = rows.filter("toxic = 1").mapInArrow(_count_terms(None), kinds)
    often = toxic.groupBy("term").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least).select("term")
    known = np.sort(np.array([r.term for r in often.collect()], np.int64).view(np.uint64))
    counts = rows.mapInArrow(_count_terms(known), kinds).groupBy("term").pivot("kind", [0, 1, 2, 3]).agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses")).fillna(0)
    table = counts.toPandas()
    out = []
    for halves in ((0,), (1,), (0, 1)):
        total = lambda what, toxic, halves=halves: sum(table[f"{2 * h + toxic}_{what}"] for h in halves)
        n = [max(1, sum(sizes.get((h, t), 0) for h in halves)) for t in (0, 1)]
        odds = np.log((total("uses", 1) + 0.5) / n[1]) - np.log((total("uses", 0) + 0.5) / n[0])
        docs = np.log((total("docs", 1) + 0.5) / n[1]) - np.log((total("docs", 0) + 0.5) / n[0])
        rated = table[["term"]].assign(odds=odds, score=odds + 0.5 * np.log(total("docs", 1).clip(1)))
        good = rated[(total("docs", 1) >= max(3, MIN_SHARE * n[1])) & (odds > 2) & (docs > 1.2)]
        good = good.sort_values(["score", "term"], ascending=False).head(max_terms)
        out.append(Lexicon(good.term.tolist(), good.term[good.odds > STRONG].tolist()))
    return out


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, column: pa.Array) -> np.ndarray:
        margin = self.trees.margin(features(column, self.lexicon))
        # calibrated, with a hundredth of the trees' own probability so that the order within a pool stays
        return np.clip(0.99 * self.calibration(margin) + 0.01 / (1 + np.exp(-margin)), 0, 1)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel | None:
    held = Stored(training_rows(text_batches(docs), labels, max_rows), "toxicity-rows")
    lexicons = learn_lexicons(held.df)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = np.asarray(batch.column(1))
            both = [features(batch.column(2), lexicons[1 - h]) for h in (0, 1)]  # by the other half's lexicon
            x = np.where((half == 0)[:, None], both[0], both[1])
            kinds = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(1), pa.array(x.tolist(), kinds)], names=["toxic", "half", "x"])

    got = held.df.mapInArrow(table, "toxic int, half int, x array<double>").toArrow()
    held.drop()
    if got.num_rows == 0:
        return None
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(NAMES))
    y, half = np.asarray(got["toxic"]).astype(float), np.asarray(got["half"])
    order = np.lexsort((*x.T, y, half))  # the rows' order must not matter
    x, y, half = x[order], y[order], half[order]
    margin = np.zeros(len(y))
    for h in (0, 1):
        margin[half == h] = BoostedTrees().fit(x[half != h], y[half != h]).margin(x[half == h]) if (half == h).any() else 0
    return ToxicityModel(lexicons[2], BoostedTrees().fit(x, y), Isotonic().fit(margin, y))


def scored(docs: DataFrame, model: ToxicityModel | None, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score as a last column."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column(at)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[str(k) for k in range(batch.num_columns + 1)])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, max_rows))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """Documents that score below the threshold; columns are those of docs."""
    name = fresh("toxicity", docs.columns)
    return scored(docs, train(docs, labels, max_rows), name=name).filter(F.col(name) < threshold).drop(name)
