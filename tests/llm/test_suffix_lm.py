"""Suffix dedup against counting every string; the loser tree; LM scores against a dictionary model."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm_score, suffix_dedup


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(4)
    runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    tree = suffix_dedup.LoserTree([suffix_dedup.decoded(*suffix_dedup.front_coded(r)) for r in runs])
    got = list(tree)
    assert [t for *_, t in got] == sorted(t for r in runs for t in r)
    for (_, _, before), (_, shared, text) in zip(got, got[1:]):
        assert shared == suffix_dedup.common_prefix(before, text, 0)
    assert list(suffix_dedup.LoserTree([])) == []


@pytest.mark.parametrize("length, seed, hot", [(200, 80, suffix_dedup.HOT), (40, 10, suffix_dedup.HOT), (200, 80, 1), (40, 10, 3)])
def test_repeats(spark, sf, length, seed, hot):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    p = texts[10][:700]
    texts += [p + texts[11][:100], "zz" + p[100:420] + "yy" + p[300:650], "x" * 1000, "ab" * 300, None, "", texts[3], "ü" * 150 + texts[4][20:240] + "é", "q" * 199, "q" * 200, "hello wörld " * 40, "q" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length, seed, hot_places=hot).collect())
    assert got == [(k, *w) for k, w in enumerate(suffix_dedup.brute_force(texts, length))]


def test_anchors_as_a_stream():
    """Folding early finds the same places, those of one text sent twice aside."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(20):
        gram, tid, at = rng.integers(0, 60, 25).astype(np.uint64), rng.integers(0, 8, 25), rng.integers(0, 5, 25).astype(np.int32)
        none = np.zeros(25, np.uint8)
        rows.append({"gram": gram.tobytes(), "tid": tid.tobytes(), "at": at.tobytes(), "low": none.tobytes(), "high": none.tobytes()})
    made = []
    for held in (1 << 20, 10):
        found, hot = set(), set()
        for batch in suffix_dedup._repeated(12, held)(iter(pa.RecordBatch.from_pylist([r]) for r in rows)):
            for r in batch.to_pylist():
                if r["tid"] is None:
                    hot.add(r["gram"])
                else:
                    found |= {(r["tid"], p[0]) for p in np.frombuffer(r["places"], suffix_dedup.PLACE).tolist()}
        made.append(found)
        assert hot
    assert made[0] == made[1] and made[0]


def test_no_texts(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (1, "short")], "doc_id long, text string")
    assert {r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()} == {0}
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_nothing_repeats(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, "".join(rng.choices("abcdefgh ", k=400))) for k in range(6)], "doc_id long, text string")
    assert {r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()} == {0}


def reference(docs, good, size):
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, t in docs}
    words = Counter(w for ws in split.values() for w in ws)
    known = {w for w, n in words.items() if n > 1}
    assert len(known) < size
    code = {k: [w if w in known else None for w in ws] for k, ws in split.items()}
    models = []
    for own in (good, set(split)):
        uni = Counter(w for k in own for w in code[k])
        models.append((uni, Counter(p for k in own for p in zip(code[k], code[k][1:])), sum(uni.values())))
    out = {}
    for k, ws in code.items():
        losses = []
        for uni, bi, n in models:
            p = lambda w: (uni[w] + 1) / (n + len(known) + 1)  # noqa: B023, E731
            loss = [-math.log(p(ws[0]))] if ws else []
            loss += [-math.log((bi[u, v] + lm_score.MU * p(v)) / (uni[u] + lm_score.MU)) for u, v in zip(ws, ws[1:])]
            losses.append(sum(loss) / len(ws) if ws else None)
        out[k] = losses
    return out


def test_lm_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.union(spark.createDataFrame([(9000, None), (9001, " "), (9002, "the"), (9003, docs.first().text)], "doc_id long, text string")).cache()
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(60)] + [(None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {k for k, _ in rows}
    want = reference(rows, {k for k in ids if k < 60 and k % 3 == 0}, 1 << 15)
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, labels).collect()}
    assert set(got) == ids
    for k, (t, b) in want.items():
        if t is None:
            assert got[k].score is None and got[k].n_tokens == 0
        else:
            assert got[k].target_loss == pytest.approx(t, rel=1e-5) and got[k].background_loss == pytest.approx(b, rel=1e-5)


def test_lm_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lm_score.cross_entropy_difference(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")
    assert lm_score.cross_entropy_difference(one, labels).first().score is not None
