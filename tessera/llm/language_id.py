"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into segments of ``STEPS`` bytes. Forward and backward GRU states label every byte of a segment; a
document's probabilities are the means over its bytes. The network is trained by backpropagation through time on about
``ROWS`` documents per language (chosen by a hash of their id), at most ``PER_TEXT`` segments of each, and ``SEGMENTS``
segments of each language; one quarter of the ids (crc32 of the id modulo 4 is 2) is held out. Only text is read to predict.

A text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn from.
Of equal probabilities the first language by code point wins. Repeated rows get equal results, and repeated ids all train.
A very long text is labelled over all of its bytes, ``LANES`` segments at a time. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import chunks
from tessera.llm.store import text_batches

STEPS = 96
HIDDEN = 8
ROWS = 150
SEGMENTS = 1_200
#: Segments of one text that training may draw from: the driver's sample is bounded however long texts are.
PER_TEXT = 256
EPOCHS = 10
BATCH = 96
LANES = 2048
UNKNOWN = "und"


class ByteGru:
    """Weights of both directions are stacked on the first axis. Gates are kept at half scale: sigmoid(2x) = (1 + tanh x) / 2."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.RandomState(seed)
        draw = lambda *shape: rng.uniform(-0.3, 0.3, shape).astype(np.float32)
        self.classes, self.hidden = classes, hidden
        self.w = {"gates_in": draw(2, 256, 2 * hidden), "new_in": draw(2, 256, hidden), "gates": draw(2, hidden, 2 * hidden), "new": draw(2, hidden, hidden), "out": draw(2, hidden, len(classes)), "bias": np.zeros(len(classes), np.float32)}

    def forward(self, x: np.ndarray, keep: bool = False):
        """Logits (step, lane, class) of byte segments x (step, lane); with ``keep`` also what the backward pass needs."""
        w, (steps, lanes), n = self.w, x.shape, self.hidden
        logits = np.empty((steps, lanes, len(self.classes)), np.float32)
        logits[:] = w["bias"]
        h, kept = np.zeros((2, lanes, n), np.float32), []
        gates, new = np.empty((2, lanes, 2 * n), np.float32), np.empty((2, lanes, n), np.float32)
        for t in range(steps):
            seen = (x[t], x[steps - 1 - t])
            np.matmul(h, w["gates"], out=gates)
            for d in (0, 1):
                gates[d] += w["gates_in"][d].take(seen[d], axis=0)
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            update, reset = gates[..., :n], gates[..., n:]
            np.matmul(reset * h, w["new"], out=new)
            for d in (0, 1):
                new[d] += w["new_in"][d].take(seen[d], axis=0)
            np.tanh(new, out=new)
            if keep:
                kept.append((seen, h.copy(), update.copy(), reset.copy(), new.copy()))
            h += update * (new - h)
            out = np.matmul(h, w["out"])
            logits[t] += out[0]
            logits[steps - 1 - t] += out[1]
            if keep:
                kept[-1] += (h.copy(),)
        return (logits, kept) if keep else logits

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the real bytes of segments with classes y, and its gradient by backpropagation through time."""
        w, n, (steps, lanes) = self.w, self.hidden, x.shape
        logits, kept = self.forward(x, keep=True)
        p = softmax(logits)
        loss = -float((np.log(np.maximum(p[:, np.arange(lanes), y], 1e-9)) * real).sum() / real.sum())
        p[:, np.arange(lanes), y] -= 1
        p *= (real / real.sum())[..., None]
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["bias"] = p.sum(axis=(0, 1))
        dh = np.zeros((2, lanes, n), np.float32)
        into = [np.zeros((steps, lanes, 3 * n), np.float32), np.zeros((steps, lanes, 3 * n), np.float32)]
        for t in range(steps - 1, -1, -1):
            _, h, update, reset, new, after = kept[t]
            dout = np.stack([p[t], p[steps - 1 - t]])
            grad["out"] += after.transpose(0, 2, 1) @ dout
            dh += dout @ w["out"].transpose(0, 2, 1)
            dnew = dh * update * (1 - new**2)
            dupdate = dh * (new - h) * update * (1 - update) * 2
            dreset_h = dnew @ w["new"].transpose(0, 2, 1)
            dreset = dreset_h * h * reset * (1 - reset) * 2
            dgates = np.concatenate([dupdate, dreset], axis=2)
            grad["new"] += (reset * h).transpose(0, 2, 1) @ dnew
            grad["gates"] += h.transpose(0, 2, 1) @ dgates
            dh = dh * (1 - update) + dreset_h * reset + dgates @ w["gates"].transpose(0, 2, 1)
            for d in (0, 1):
                into[d][t, :, : 2 * n], into[d][t, :, 2 * n :] = dgates[d], dnew[d]
        for d in (0, 1):
            seen = (x if d == 0 else x[::-1]).reshape(-1)
            sums = np.zeros((256, 3 * n), np.float32)
            np.add.at(sums, seen, into[d].reshape(-1, 3 * n))
            grad["gates_in"][d], grad["new_in"][d] = sums[:, : 2 * n], sums[:, 2 * n :]
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 9) -> ByteGru:
        """Adam over batches of segments (lane, step)."""
        rng = np.random.RandomState(seed)
        first, second, step = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in (0, 1)), 0, 0
        first, second = first
        total = epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                own = order[k : k + BATCH]
                _, grad = self.gradients(np.ascontiguousarray(x[own].T), y[own], real[own].T.astype(np.float32))
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                step += 1
                now = rate * (1 - 0.95 * step / total)
                for name, g in grad.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g**2 - second[name])
                    self.w[name] -= (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def document_probabilities(self, column: pa.Array) -> np.ndarray:
        """(row, class): means of the class probabilities over all bytes of each text; zeros for empty ones."""
        out = np.zeros((len(column), len(self.classes)))
        for first, stop, buf, starts, ends in chunks(column):
            row, begin = segments(starts, ends)
            sums = np.zeros((stop - first, len(self.classes)))
            for k in range(0, len(row), LANES):
                own = slice(k, k + LANES)
                x, real = segment_bytes(buf, begin[own], ends[row[own]])
                p = softmax(self.forward(np.ascontiguousarray(x.T)))
                p *= real.T[..., None]
                np.add.at(sums, row[own], p.sum(axis=0))
            out[first:stop] = sums / np.maximum(ends - starts, 1)[:, None]
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    p = logits - logits.max(axis=-1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=-1, keepdims=True)
    return p


def segments(starts: np.ndarray, ends: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte) of each segment."""
    count = -(-(ends - starts) // steps)
    row = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, starts[row] + nth * steps


def segment_bytes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes (segment, step) filled up with spaces, which bytes are real)."""
    at = begin[:, None] + np.arange(steps)
    real = at < end[:, None]
    return np.where(real, buf[np.minimum(at, len(buf) - 1)], 0x20).astype(np.uint8), real


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sampled_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text's segments at most ``PER_TEXT``, by chance that depends on the text's length only."""
    for batch in batches:
        lang, held, length = [], [], []
        for k, name in enumerate(batch.column(0).to_pylist()):
            for _, _, buf, starts, ends in chunks(batch.column(1).slice(k, 1)):
                row, begin = segments(starts, ends)
                if len(begin) > PER_TEXT:
                    begin = np.sort(np.random.RandomState(len(begin)).permutation(len(begin))[:PER_TEXT]) * STEPS + starts[0]
                x, real = segment_bytes(buf, begin, np.full(len(begin), ends[0]))
                lang += [name] * len(x)
                held += [v.tobytes() for v in x]
                length += real.sum(axis=1).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(held, pa.binary()), pa.array(length, pa.int32())], names=["lang", "bytes", "length"])


def train(docs: DataFrame, rows: int = ROWS) -> ByteGru | None:
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    classes = sorted(counts)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(v) for k in classes for v in (k, rows / counts[k])]), F.col("lang"))
    sample = known.filter(chance < share).select("lang", "text").mapInArrow(_sampled_segments, "lang string, bytes binary, length int").toArrow()
    rng = np.random.RandomState(3)
    xs, ys, reals = [], [], []
    kind, held, length = np.array(sample["lang"].to_pylist()), np.array(sample["bytes"].to_pylist(), object), np.asarray(sample["length"])
    for k, name in enumerate(classes):
        own = np.flatnonzero(kind == name)
        own = own[np.lexsort((length[own], held[own]))]  # the rows' order must not matter
        own = own[rng.permutation(len(own))[:SEGMENTS]]
        if len(own):
            xs.append(np.frombuffer(b"".join(held[own]), np.uint8).reshape(-1, STEPS))
            reals.append(np.arange(STEPS) < length[own][:, None])
            ys.append(np.full(len(own), k))
    if not xs:
        return None
    return ByteGru(classes).fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(reals))


def predict_languages(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.asarray(batch.column(2)) & (model is not None)
            names, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if some.any():
                p = model.document_probabilities(batch.column(1).filter(pa.array(some)))
                names[some] = np.array(model.classes, object)[p.argmax(axis=1)]
                score[some] = np.clip(p.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_ids(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    return predict_languages(text_batches(docs), train(docs, rows)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
