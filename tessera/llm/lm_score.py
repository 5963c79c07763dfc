"""LM scoring by cross-entropy difference of two matched bigram models.

The target model counts the documents of labelled good quality, the background model counts all documents; both share
one vocabulary (every word that occurs twice or more in the corpus, the rest is one unknown word), order and smoothing:
p(v|u) = (c(uv) + MU p(v)) / (c(u) + MU) over p(v) = (c(v) + 1) / (N + V). A document's score is the mean over its
tokens of target loss minus background loss, in nats; lower is closer to the target.

Neither words nor bigrams are bounded, so no task holds either table. The texts become blocks of about ``FLUSH`` tokens,
each with its distinct words and the tokens as places among them. A block sends each distinct word with its counts once
to a bucket by hash, the bucket adds up and answers each block with the sums; the same again with the block's distinct
bigrams. A word or bigram of any frequency is thus one entry a block. Then each block prices its documents alone.

Words are identified by a 64-bit hash. Null, empty and wordless texts have no tokens and a null score. Without a labelled
document the target model is its smoothing alone. Repeated rows count and are scored each; a document labelled twice is
good if any label says so. A very long text is one document of a block, which then has more than ``FLUSH`` tokens, some
100 bytes each. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.bytescan import NOT_SPACE, Words, chunks, gram_hashes, release
from tessera.llm.store import MAX_TASKS, buckets_for, dealt, stored, text_batches

MU = 200.0
FLUSH = 1 << 20
_U = np.uint64


def _sums(values: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values and the sums of the weights of each."""
    names, at = np.unique(values, return_inverse=True)
    return names, *(np.bincount(at, w, len(names)).astype(np.int64) for w in weights)


def _squeezed(values: np.ndarray, sorted_runs: bool = False) -> bytes:
    """Whole numbers as compressed byte planes, in front of them their count; hashes in sorted runs as differences."""
    if sorted_runs:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expanded(data: bytes, kind: type, sorted_runs: bool = False) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], size * width, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    values = np.ascontiguousarray(planes.reshape(width, size).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if sorted_runs else values


def _joined(rows: list[bytes], kind: type, sorted_runs: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_expanded(b, kind, sorted_runs) for b in rows)])


def _blocks(kind: pa.DataType):
    """mapInArrow function over (target, doc_id, text): blocks of documents; ``words`` are hashes, frequent ones first, ``tokens`` places in them, ``runs`` tokens of each document."""

    def flush(number: int, held: list[np.ndarray], runs: list[np.ndarray], targets: list[np.ndarray], ids: list[pa.Array]) -> pa.RecordBatch:
        words, tokens, n = np.unique(np.concatenate([np.zeros(0, _U), *held]), return_inverse=True, return_counts=True)
        order = np.lexsort((words, -n))
        place = np.zeros(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        words, tokens = words[order], place[tokens]
        block = TaskContext.get().partitionId() << 32 | number
        values = pa.concat_arrays(ids)
        packed = [_squeezed(words, True), *map(_squeezed, (tokens, np.concatenate(runs).astype(np.int32), np.concatenate(targets).astype(np.uint8)))]
        arrays = [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), *(pa.array([p], pa.binary()) for p in packed)]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "words", "tokens", "runs", "targets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, runs, targets, ids, count = 0, [], [], [], [], 0
        for batch in batches:
            target, doc_id = np.asarray(batch.column(0)), batch.column(1).cast(kind)
            for first, stop, buf, starts, _ in chunks(batch.column(2)):
                found = Words(buf, starts, NOT_SPACE)
                held.append(found.hash)
                runs.append(np.bincount(found.doc, minlength=stop - first))
                targets.append(target[first:stop])
                ids.append(doc_id[first:stop])
                count += len(found.hash)
                if count > FLUSH:
                    yield flush(number, held, runs, targets, ids)
                    number, held, runs, targets, ids, count = number + 1, [], [], [], [], 0
        if ids:
            yield flush(number, held, runs, targets, ids)

    return run


def _open(row: dict) -> tuple[np.ndarray, ...]:
    """(words, tokens, document of each token, target of each token) of a block."""
    words, tokens, runs, targets = (_expanded(row[c], k, c == "words") for c, k in (("words", _U), ("tokens", np.int32), ("runs", np.int32), ("targets", np.uint8)))
    doc = np.repeat(np.arange(len(runs)), runs)
    return words, tokens, doc, targets[doc].astype(float)


def _freed(df: DataFrame) -> DataFrame:
    """The same table; the shuffles of earlier steps, which nothing refers to any more, leave the disk."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


ASKED = "bucket int, block long, hash binary, n binary, nt binary"
TOTALS = ["known", "n_all", "n_target", "single_all", "single_target"]
ANSWERED = "bucket int, block long, n binary, nt binary, " + ", ".join(f"{c} long" for c in TOTALS)


def _bucket_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of hashes and the order of a block's entries in which it asks and is answered."""
    bucket = ((hashes >> _U(20)) % _U(buckets)).astype(np.int64)
    return bucket, np.lexsort((hashes, bucket))


def _ask(block: int, hashes: np.ndarray, n: np.ndarray, nt: np.ndarray, buckets: int) -> pa.Table:
    bucket, order = _bucket_order(hashes, buckets)
    names, cut = np.unique(bucket[order], return_index=True)
    ends = np.append(cut[1:], len(order))[: len(names)]
    packed = [[f(v[order][a:b]) for a, b in zip(cut, ends, strict=True)] for v, f in ((hashes, lambda x: _squeezed(x, True)), (n.astype(np.int64), _squeezed), (nt.astype(np.int64), _squeezed))]
    return pa.table([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), block, np.int64)), *(pa.array(p, pa.binary()) for p in packed)], names=["bucket", "block", "hash", "n", "nt"])


def _ask_words(buckets: int):
    """mapInArrow function over blocks: each block's distinct words with their counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, tokens, _, target = _open(row)
                yield from _ask(row["block"], words, np.bincount(tokens, minlength=len(words)), np.bincount(tokens, target, len(words)), buckets).to_batches()

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """The sums over all blocks of a bucket's entries, back to each block; one row has the number of those that occur twice or more and the sums of all and of the others."""
    release()  # what the last bucket held
    asked = [_expanded(b, _U, True) for b in table["hash"].to_pylist()]
    hashes, n, nt = np.concatenate(asked), *(_joined(table[c].to_pylist(), np.int64) for c in ("n", "nt"))
    names, at = np.unique(hashes, return_inverse=True)
    n, nt = (np.bincount(at, w, len(names)).astype(np.int64) for w in (n, nt))
    cut = np.cumsum([0, *map(len, asked)])
    totals = np.zeros((len(TOTALS), table.num_rows), np.int64)
    totals[:, 0] = (n > 1).sum(), n.sum(), nt.sum(), n[n == 1].sum(), nt[n == 1].sum()
    packed = [pa.array([_squeezed(v[at[a:b]]) for a, b in zip(cut, cut[1:])], pa.binary()) for v in (n, nt)]
    return pa.table([table["bucket"], table["block"], *packed, *map(pa.array, totals)], names=["bucket", "block", "n", "nt", *TOTALS])


def _answers(table: pa.Table, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, nt) of a block's entries from the answers of all buckets."""
    _, order = _bucket_order(hashes, buckets)
    table = table.sort_by("bucket")
    out = []
    for values in (_joined(table[c].to_pylist(), np.int64) for c in ("n", "nt")):
        placed = np.zeros(len(hashes), np.int64)
        placed[order] = values
        out.append(placed)
    return tuple(out)


def _bigrams(words: np.ndarray, known: np.ndarray, tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a token follows one of its document, hashes of the bigrams that end in those), unknown words being one word."""
    follows = np.zeros(len(tokens), bool)
    follows[1:] = doc[1:] == doc[:-1]
    return follows, gram_hashes(np.where(known, words, _U(0))[tokens], doc, 2)[1]


def _ask_bigrams(buckets: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        release()  # what the last block held
        words, tokens, doc, target = _open(left.to_pylist()[0])
        n, _ = _answers(right, words, buckets)
        follows, grams = _bigrams(words, n > 1, tokens, doc)
        return _ask(key[0].as_py(), *_sums(grams, np.ones(len(grams)), target[follows]), buckets)

    return run


def _price(buckets: int, totals: tuple[int, int], unknown: tuple[int, int], size: int, kind: pa.DataType):
    """cogroup function: losses of a block's documents. ``totals`` and ``unknown`` are tokens in all and of the unknown word, by the target and the background; ``size`` is the number of known words."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        release()  # what the last block held
        row = left.to_pylist()[0]
        words, tokens, doc, _ = _open(row)
        is_word = np.asarray(right["bigram"]) == 0
        n, nt = _answers(right.filter(pa.array(is_word)), words, buckets)
        follows, grams = _bigrams(words, n > 1, tokens, doc)
        names, at = np.unique(grams, return_inverse=True)
        m, mt = _answers(right.filter(pa.array(~is_word)), names, buckets)
        runs = _expanded(row["runs"], np.int32)
        first = np.flatnonzero(follows) - 1
        out = []
        for k, (uni, bi) in enumerate(((nt, mt), (n, m))):
            count = np.where(n > 1, uni, unknown[k]).astype(float)
            p = ((count + 1) / (totals[k] + size + 1))[tokens]
            loss = -np.log(p)
            loss[follows] = -np.log((bi[at] + MU * p[follows]) / (count[tokens[first]] + MU))
            total = np.bincount(doc, loss, len(runs))
            out.append(pa.array(total / np.maximum(runs, 1), mask=runs == 0))
        return pa.table([pa.array(row["ids"], kind), pa.array(runs.astype(np.int64)), *out], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    return run


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, target_loss, background_loss (means over tokens), score (their difference)."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    good = stored(good, "lm-good")
    rows = text_batches(docs).select("doc_id", "text")
    side = F.broadcast(good) if good.count() * 16 <= 32 << 20 else good
    marked = rows.join(side, rows["doc_id"] == side["good_id"], "left").select(F.col("good_id").isNotNull().cast("int").alias("target"), "doc_id", "text")
    buckets = buckets_for(docs, 20)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    blocks = stored(marked.mapInArrow(_blocks(arrow), f"block long, ids array<{kind}>, words binary, tokens binary, runs binary, targets binary"), "lm-blocks")
    asked = blocks.drop("ids").mapInArrow(_ask_words(buckets), ASKED)
    words = _freed(stored(dealt(asked, buckets).groupBy("bucket").applyInArrow(_answer, ANSWERED), "lm-words"))
    size, n_all, n_target, single_all, single_target = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in TOTALS)).first()
    words = words.drop(*TOTALS)
    tasks = min(buckets, MAX_TASKS)  # a few blocks each

    def by_block(table: DataFrame):
        return table.repartition(tasks, "block").groupBy("block")

    pairs = by_block(blocks.drop("ids")).cogroup(by_block(words)).applyInArrow(_ask_bigrams(buckets), ASKED)
    bigrams = _freed(stored(dealt(pairs, buckets).groupBy("bucket").applyInArrow(_answer, ANSWERED).drop(*TOTALS), "lm-bigrams"))
    answers = words.withColumn("bigram", F.lit(0)).unionByName(bigrams.withColumn("bigram", F.lit(1)))
    price = _price(buckets, (n_target, n_all), (single_target, single_all), size, arrow)
    out = by_block(blocks).cogroup(by_block(answers)).applyInArrow(price, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
