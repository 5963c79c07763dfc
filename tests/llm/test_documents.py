"""Operators on documents against brute force, and their defined results at the edges."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, mixing, ngram_join, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "...", "a", "a b c", "Ünï çödé straße", "x" * 50_000, "w " * 3_000, "a b c", "one two three four five six seven eight nine ten eleven twelve"]


def frame(spark, texts, sources=("s1", None, "s0")):
    rows = [(k, t, "en", sources[k % len(sources)], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "a b c", None, None, None), (3, "...", "en", "s0", 3)], DOCS)


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def components(sets, percent):
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("cap", [20_000, 3])
def test_ngram_components(spark, sf, cap):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    extra = [(1000 + k, " ".join(words(rows[5].text)[k:])) for k in range(6)] + [(1100, rows[7].text + " tail"), (1101, rows[7].text.upper())]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    sets = {r.doc_id: shingles(r.text, 4) for r in docs.collect()}
    want = components(sets, 85)
    got = {r.doc_id: r for r in ngram_join.similarity_components(docs, 4, 85, cluster_cap=cap).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}


def test_wide_ngrams_in_pieces(spark):
    base = [f"t{k}" for k in range(60)]
    rng = np.random.default_rng(1)
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.integers(0, 60, k % 5):
            own[at] = f"z{k}"
        texts.append(" ".join(own))
    docs = frame(spark, texts)
    want = components({k: shingles(t, 4) for k, t in enumerate(texts)}, 85)
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_components(docs.filter("doc_id is not null and text <> '...'"), 4, 85, tree_cap=8, cluster_cap=12).collect()}
    assert got == want


def test_blocks_are_folded(spark):
    """What a bucket holds of widespread n-grams doesn't change the sets of its blocks."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        gram, node = rng.choice([1, 1, 1, 2, 3, 4], 50).astype(np.uint64), rng.integers(0, 90, 50)
        nodes, owner = np.unique(node, return_inverse=True)
        rows.append({"grams": gram.tobytes(), "owners": owner.astype(np.int32).tobytes(), "nodes": nodes.tobytes()})
    made = []
    for held in (1 << 22, 10):
        groups = defaultdict(set)
        for batch in ngram_join._blocks(40, held)(iter(pa.RecordBatch.from_pylist([r]) for r in rows)):
            for r in batch.to_pylist():
                groups[r["whole"]].add(frozenset(r["nodes"]))
        made.append((frozenset().union(*groups[True]), groups[False]))
    assert made[0] == made[1] and made[0][0]


def test_unlike_sizes_make_no_clusters(spark):
    """An n-gram that many documents share, all too unlike in size or late in the order, makes no candidate cluster of them."""
    texts = [" ".join(["the common four words", *(f"d{k}w{j}" for j in range(20 + 6 * k * k))]) for k in range(24)]
    texts += [texts[9] + " more", texts[15] + " and some more"]
    docs = frame(spark, texts).filter("doc_id is not null and text <> '...'")
    rows = docs.select("text").mapInArrow(ngram_join._prefixes(4, 85, np.zeros(0, np.uint64), 1), "bucket int, grams binary, owners binary, nodes binary, sizes binary, shorts binary")
    batches = [pa.RecordBatch.from_pylist([r.asDict()]) for r in rows.collect()]
    made = [r for b in ngram_join._blocks(8, percent=85)(iter(batches)) for r in b.to_pylist()]
    node = {k: ngram_join.set_node(h) for k, h in ngram_join.ngram_sets(pa.array(texts), 4)}
    assert not [r for r in made if r["whole"]]
    assert {frozenset((node[9], node[24])), frozenset((node[15], node[25]))} <= {frozenset(r["nodes"]) for r in made}
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_components(docs, 4, 85, tree_cap=8).collect()}
    assert got == components({k: shingles(t, 4) for k, t in enumerate(texts)}, 85) and got[24] == 9


def test_size_parts_hold_all_near_pairs():
    rng = np.random.default_rng(2)
    for percent in (50, 80, 85, 99, 100):
        gram, size = rng.integers(0, 3, 300), np.append(rng.integers(1, 40, 150), rng.integers(1, 5000, 150))
        order = np.lexsort((size, gram))
        gram, size = gram[order], size[order]
        for most in (1, 20, 1000):
            groups = defaultdict(set)
            for at, part in zip(*(v.tolist() for v in ngram_join.size_parts(gram, size, percent, most)), strict=True):
                groups[at].add(part)
            for a, b in combinations(range(300), 2):
                near = gram[a] == gram[b] and 100 * min(size[a], size[b]) >= percent * max(size[a], size[b])
                assert not near or groups[a] & groups[b]
                assert gram[a] == gram[b] or not groups[a] & groups[b]


def test_ngram_edges(spark):
    got = ngram_join.similarity_components(frame(spark, ODD), 4, 85).collect()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert len(got) == len(ODD) + 2
    assert by[0, 0] == 0 and by[1, 0] == 1 and by[2, 0] == 2 and by[3, 1] == 3 and by[5, 1] == 5 and by[9, 1] == 5 and by[None, 1] == 5
    assert ngram_join.similarity_components(frame(spark, []).limit(0)).collect() == []
    kept = ngram_join.one_of_each(frame(spark, ODD)).collect()
    ids = [r.doc_id for r in kept]
    assert 9 not in ids and ids.count(3) == 1 and {0, 1, 2, 5} <= set(ids)


def test_decontamination(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    extra = spark.createDataFrame([(None, "no id but ten words are in here of it all"), (9001, "Short item"), (9002, "..."), (9003, None), (9001, "short ITEM")], "item_id long, text string")
    items = items.union(extra)
    more = [*ODD, "a short, item and no id but ten words are in here of it all!", items.first().text.upper() + " and " + items.first().text]
    docs = docs.select("doc_id", "text").union(frame(spark, more).select("doc_id", "text"))
    known = [(None if r.item_id is None else str(r.item_id), r.text) for r in items.collect()]
    want = Counter((r.doc_id, *decontaminate.brute_force_row(r.text, known)) for r in docs.filter("length(text) < 3000 or text is null").collect())
    for bound in (1 << 24, 800):
        got = decontaminate.contamination(docs.filter("length(text) < 3000 or text is null"), items, max_item_bytes=bound).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    assert sum(r.contaminated for r in got) > 3


def test_decontaminate_text(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b c d e f g h i j! and a long tail of other words that stays with it, as it is here", 7), (2, "a b c d e f g h i j", 7), (3, None, 7)], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_words) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: ("Keep this. ! and a long tail of other words that stays with it, as it is here", 7), 3: (None, 7)}
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 3
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_sharding_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.shard_documents(docs, 7).collect()
    assert len(got) == docs.count()
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(load) == set(range(7)) and max(load.values()) - min(load.values()) <= max(r.size for r in got)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(frame(spark, ODD)).count() == len(ODD) + 2
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    size = {r.doc_id: r["size"] for r in sharding.shard_documents(frame(spark, ODD[:3])).filter("doc_id < 3").collect()}
    assert size == {0: 16, 1: 16, 2: 20}


def test_slot_map_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sized = sharding.with_sizes(docs).withColumn("vslot", sharding.virtual_slot("doc_id", slots=64))
    sizes = sharding.slot_sizes(sized).cache()
    one = sharding.place_slots(sizes, 4).cache()
    two = sharding.grow(one, sizes, 4).cache()
    before, after = ({r.vslot: r.shard for r in m.collect()} for m in (one, two))
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(after[k] == 4 for k in moved) and {r.version for r in two.collect()} == {2}
    sharding.save_map(one, str(tmp_path / "map"))
    sharding.save_map(two, str(tmp_path / "map"))
    assert {r.vslot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map")).collect()} == after
    assert {r.vslot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()} == before
    skewed = one.withColumn("shard", sharding.F.when(sharding.F.col("vslot") % 2 == 0, 0).otherwise(sharding.F.col("shard")).cast("int")).cache()
    even = sharding.rebalance(skewed, sizes, 4).cache()
    was, now = ([r.bytes for r in sharding.loads(m, sizes).collect()] for m in (skewed, even))
    assert max(now) < max(was) and sum(now) == sum(was) and even.count() == skewed.count()


def water_fill(sizes, weights=(5, 2, 1), stop=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(stop * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: stop * sizes[s] if s in full else rest * weight[s] / share for s in order}
        above = {s for s in order if target[s] > stop * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("block", [20_000, 8])
def test_mixing(spark, sf, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix_documents(docs, block_rows=block).collect()
    again = mixing.mix_documents(docs.repartition(5, "n_chars"), block_rows=block).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        assert r["size"] == 0 or r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    want = water_fill(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert {r.doc_id: r["size"] for r in got} == {r.doc_id: len(words(r.text)) for r in docs.collect()}


def test_mixing_edges(spark):
    odd = frame(spark, ODD)
    got = mixing.mix_documents(odd).collect()
    assert len(got) == len(ODD) + 2 and {r["size"] for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert mixing.mix_documents(odd.limit(0)).collect() == []
    rows = mixing.mixed_rows(odd)
    taken = sum(r.taken for r in got)
    assert rows.columns == odd.columns and sum(len(words(r.text)) for r in rows.collect()) == taken


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size, prob = rng.integers(1, 500, 400).astype(float), rng.random(400)
    out = mixing.flight(prob, size, rng)
    assert ((out > mixing.EPS) & (out < 1 - mixing.EPS)).sum() <= 2
    assert out.sum() == pytest.approx(prob.sum()) and out @ size == pytest.approx(prob @ size)
    same = mixing.flight(np.full(9, 0.5), np.full(9, 4.0), rng)
    assert same.sum() == pytest.approx(4.5)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).toPandas()
    both = got.merge(labels.toPandas(), on="doc_id")
    test = both[both.held_out]
    assert got.score.between(0, 1).all() and len(got) == 1000
    rude = "idiot moron scum".split()
    plain = test.merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    hard = plain[[any(w in t.lower() for w in rude) for t in plain.text]]
    assert hard.predicted.mean() > 0.8
    assert test[test.toxic == 0].predicted.mean() < 0.02
    odd = frame(spark, ODD)
    assert toxicity.toxicity_scores(odd, labels.limit(0)).filter("predicted = 0 and score = 0").count() == len(ODD) + 2
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns


def test_held_out_is_crc32(spark):
    import zlib

    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_items_digest_is_sha256():
    assert decontaminate.brute_force_row("x", [("b", "x"), ("a", "x")])[3] == hashlib.sha256(b"a,b").hexdigest()


def test_mixed_rows_of_repeated_rows(spark):
    """Rows that repeat share their copies however these differ, and texts are not sorted for the others."""
    rows = [(k // 3, f"w{k // 3} x y z", "a") for k in range(30)] + [(100 + k, "v " * 40, "b") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mix_documents(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    out = mixing.mixed_rows(docs)
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in taken.items() if n}
    once = mixing.mixed_rows(docs.filter("doc_id >= 100"))
    assert "Window" not in once._jdf.queryExecution().executedPlan().toString()
