"""Every operator on clashing column names, empty tables, very long texts, odd labels and repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, lm_score, mixing, ngram_join, sharding, store, suffix_dedup, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
INNER = (
    "score toxicity _toxicity held_out node copies row source_no tid spans bucket _n_words _hit_words _item_ids _kept _n _again document id hash no_id copy times nth k0 "
    "block vslot virtual_slot shard size slot version term lettered target target_loss words ids key counts whole component cluster least total rows n_words prob mixed"
).split()


def clashing(df):
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(INNER)])


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.001"
    return {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def run_all(docs, labels, items):
    """Rows of each operator's per-document result."""
    return {
        "toxicity": toxicity.toxicity_scores(docs, labels),
        "suffix": suffix_dedup.remove_repeats(docs),
        "sharding": sharding.shard_documents(docs, 5),
        "mixing": mixing.mix_documents(docs),
        "ngrams": ngram_join.similarity_components(docs),
        "language": language_id.language_ids(docs),
        "benchmark": decontaminate.contamination(docs, items),
        "tokens": token_counts.line_tokens(docs),
        "model": lm_score.cross_entropy_difference(docs, labels),
    }


def test_clashing_columns_change_nothing(tables):
    docs, labels, items = (tables[t] for t in ("documents", "labels", "benchmark"))
    more = clashing(docs)
    plain, odd = run_all(docs, labels, items), run_all(more, clashing(labels), clashing(items))
    for name, out in plain.items():
        assert out.columns == odd[name].columns
        order = lambda rows: sorted(map(str, rows))
        assert order(out.collect()) == order(odd[name].collect()), name


def test_clashing_columns_pass_through(tables):
    docs, labels, items = (tables[t] for t in ("documents", "labels", "benchmark"))
    more = clashing(docs)
    kept = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    for f in (lambda d: toxicity.drop_toxic(d, labels), ngram_join.one_of_each, lambda d: decontaminate.decontaminate(d, items), mixing.mixed_rows):
        out = f(more)
        assert out.columns == more.columns
        assert kept(out) == kept(f(docs))
        assert out.select(*INNER).distinct().collect() == more.select(*INNER).distinct().collect()


def test_empty_tables(tables, spark):
    docs, labels, items = (tables[t] for t in ("documents", "labels", "benchmark"))
    for out in run_all(docs.limit(0), labels, items).values():
        assert out.collect() == []
    some = docs.limit(30)
    for name, out in run_all(some, labels.limit(0), items.limit(0)).items():
        assert out.count() == 30, name
    for f in (lambda d: toxicity.drop_toxic(d, labels), ngram_join.one_of_each, lambda d: decontaminate.decontaminate(d, items), mixing.mixed_rows):
        assert f(docs.limit(0)).collect() == []


def test_very_long_and_repeated_texts(spark, tables):
    rng = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in range(5000)])
    long = " ".join(rng.choice(words, 400_000))
    rows = [(1, long, "en", "a", 0), (2, long + " end", "en", "a", 0), (3, "x" * 2_000_000, None, "b", 0), (4, long, "en", None, 0), (4, long, "en", None, 0), (None, None, None, None, None), (None, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {k: v.collect() for k, v in run_all(docs, tables["labels"], tables["benchmark"]).items()}
    assert all(len(v) == len(rows) for v in out.values())
    assert {r.component_id for r in out["ngrams"] if r.doc_id in (1, 2, 4)} == {1}
    removed = {r.doc_id: r.n_removed for r in out["suffix"]}
    assert removed[1] == len(long) and removed[2] == len(long) and removed[3] == 2_000_000
    assert {r.n_tokens for r in out["model"] if r.doc_id == 1} == {400_000}
    assert {r.n_words for r in out["benchmark"] if r.doc_id == 1} == {400_000}
    assert len(ngram_join.one_of_each(docs).collect()) == 4
    assert {r.size for r in out["sharding"] if r.doc_id == 3} == {2_000_016}


def test_toxicity_of_few_or_odd_labels(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    n = docs.count()
    for some in (labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(1)), labels.orderBy("doc_id").limit(10), labels.withColumn("toxic", F.lit(None).cast("int")), labels.limit(0), labels.union(labels)):
        got = toxicity.toxicity_scores(docs, some)
        assert got.count() == n and got.filter("score is null or score < 0 or score > 1").count() == 0


def test_a_null_source_is_its_own(spark):
    texts = ["a b c", "d e f g", "h i", "j k l m n", None]
    rows = [(k, t, "en", s, 0) for s in (None, "\0", "s", "") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    assert {r.source for r in got} == {None, "\0", "s", ""} and len({(r.source, r.target) for r in got}) == 4
    taken = sum(r.copies for r in got)
    assert mixing.mixed_rows(docs).count() == taken


def test_equal_rows_share_their_copies(spark):
    docs = spark.createDataFrame([(None, "a b c", None, "s", k) for k in range(9)] + [(1, "a", None, "t", 0), (2, "b c", None, "t", 0)], DOCS)
    per = {(r.doc_id, r.source): 0 for r in mixing.mix_documents(docs).collect()}
    for r in mixing.mix_documents(docs).collect():
        per[r.doc_id, r.source] += r.copies
    rows = mixing.mixed_rows(docs).collect()
    for key, n in per.items():
        assert sum((r.doc_id, r.source) == key for r in rows) == n


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError):
        store.shared_dir(Session())
    assert store.fresh("a", ["A", "a_"]) == "a__"
