"""The pipeline: each stage on its predecessor's output, held against brute force on a small corpus."""

from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import decontaminate
from tests.llm.test_documents import components, shingles, water_fill, words


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        made = f(spark, docs, sf).toPandas()
        out.append((docs.toPandas(), made))
        docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long") if len(out) < 5 else None
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    assert all(list(made.columns) == corpus_pipeline.COLUMNS for _, made in stages[:4])


def test_toxic_go_and_clean_stay(stages):
    before, after = stages[0]
    rude = before.text.str.lower().str.count("idiot|moron|scum|worthless|pathetic|loser|clown|trash|stupid|disgusting")
    assert len(set(before.doc_id[rude >= 4]) & set(after.doc_id)) <= 0.1 * (rude >= 4).sum()
    assert len(after) >= 0.85 * len(before)


def test_one_of_each_group(stages):
    before, after = stages[1]
    sets = {k: shingles(t, 5) for k, t in zip(before.doc_id, before.text, strict=True)}
    want = {k for k, c in components(sets, 80).items() if k == c}
    assert set(after.doc_id) == want and len(after) == len(want)


def test_benchmark_is_cut(stages, spark):
    before, after = stages[2]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    text = dict(zip(after.doc_id, after.text, strict=True))
    for k, t in zip(before.doc_id, before.text, strict=True):
        if len(t) > 4000:
            continue
        n_words, n_hit, *_ = decontaminate.brute_force_row(t, items)
        if n_hit == 0:
            assert text[k] == t
        elif n_hit > 0.5 * n_words:
            assert k not in text
        else:
            assert len(text[k]) < len(t)


def test_mixture_meets_targets(stages):
    before, after = stages[3]
    size = {k: len(words(t)) for k, t in zip(before.doc_id, before.text, strict=True)}
    sizes, taken = Counter(), Counter()
    for k, s in zip(before.doc_id, before.source, strict=True):
        sizes[s] += size[k]
    for k, s in zip(after.doc_id, after.source, strict=True):
        taken[s] += size[k]
    assert max(Counter(after.doc_id).values()) <= 3
    want = water_fill(sizes)
    for s in want:
        assert abs(taken[s] - want[s]) <= max(size.values())


def test_shards(stages):
    before, after = stages[4]
    assert len(after) == len(before) and after.shard.between(0, 39).all()
    for _, own in after.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
