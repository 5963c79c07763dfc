"""What earlier limits cut off."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm_score, ngram_join
from tests.llm.test_suffix_lm import reference


@pytest.mark.parametrize("flush", [1 << 19, 5000])
def test_lm_all_words(spark, monkeypatch, flush):
    """More repeated words than the 32,768 that were kept once, none more frequent than another."""
    monkeypatch.setattr(lm_score, "FLUSH", flush)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40_000)] * 2 + [f"once{k}" for k in range(500)]
    rng.shuffle(words)
    docs = [(k, " ".join(words[k::200])) for k in range(200)] + [(200, None), (None, "w1 w2")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, labels).collect()}
    want = reference(docs, {k for k in range(0, 200, 3)}, 1 << 20)
    assert set(got) == set(want)
    for k, (t, b) in want.items():
        if t is None:
            assert got[k].score is None
        else:
            assert got[k].target_loss == pytest.approx(t, rel=1e-9) and got[k].background_loss == pytest.approx(b, rel=1e-9)


def test_counts_of_very_long_texts(monkeypatch):
    """Near copies with 70,000 n-grams a group are linked, also among short texts."""
    monkeypatch.setattr(ngram_join, "MOST_GROUPS", 64)
    grams = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 64 * 70_000, np.uint64) * np.uint64(2))
    sets = [grams, grams[100:], grams[:50], grams[:49]]
    assert [int(ngram_join.group_counts(g).sum()) for g in sets] == [len(g) for g in sets]
    table = pa.table({"counts": [ngram_join.group_counts(g).tobytes() for g in sets], "n_grams": [len(g) for g in sets]})
    packed = [g.tobytes() for g in sets]
    points = ngram_join._points(table)
    assert (points.coarse.sum(axis=1) == [len(g) for g in sets]).all() and points.coarse.max() > 65_535
    links = {tuple(sorted(map(int, p))) for p in ngram_join.verify(points, packed, 90)}
    assert links == {(0, 1), (2, 3)}


def test_finer_bounds_never_cut_a_link():
    """Bounds of sets of very different sizes are at least their overlap, and rule out sets that have nothing in common."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 60_000, np.uint64)
    sets = []
    for n in (1, 5, 60, 500, 520, 900, 4000, 4300, 30_000, 36_000):
        a = np.unique(rng.choice(pool, n, replace=False))
        sets += [a, np.unique(np.concatenate([a[: int(0.95 * len(a)) + 1], rng.integers(0, 1 << 63, n // 20 + 1, np.uint64)])), np.unique(rng.integers(0, 1 << 63, n, np.uint64))]
    points = ngram_join.Points([ngram_join.group_counts(s).tobytes() for s in sets], np.array([len(s) for s in sets]))
    i, j = np.triu_indices(len(sets), 1)
    near = points.near(i, j, 80)
    far = 0
    for a, b, bound in zip(i.tolist(), j.tolist(), near.tolist()):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            assert bound >= both / (len(sets[a]) + len(sets[b])) - 1e-12
        far += bound < 0
    assert far > 0.9 * len(i)
    part = points.take(np.array([27, 4, 28]))
    assert part.near(np.array([0]), np.array([2]), 80)[0] == points.near(np.array([27]), np.array([28]), 80)[0]
