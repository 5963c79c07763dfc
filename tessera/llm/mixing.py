"""Mixing sources to target weights by cube-method balanced sampling.

Targets: sources share the words of the whole corpus by weight; a target stops at ``MAX_EPOCHS`` times its source's
words and the excess goes to the others by weight until none is above its stop. A document of a source with target t
and s words should be taken t / s times: the whole part of that always, the fractional part as an inclusion
probability. The cube method's flight moves those probabilities along null-space directions of the balancing
constraints (words and documents of a source), so both totals stay where they are, until at most as many documents as
there are constraints have not reached 0 or 1. Flights run in blocks of documents; what is left of the blocks flies
again, block by block, until one block a source holds all that is left, which is the small landing problem.

Null texts have no words and count in source null, the last one, when the source is null too. A source without words
has target 0. An empty table gives an empty result. Rows that repeat are separate documents; ties between equal rows
don't matter, as they are interchangeable. A very long text is one document, and its source's total may miss the target
by its size. Other columns, whatever their names, pass through. Random numbers derive from a fixed seed, the source's
number and the documents' order by hash of (doc_id, size), then size and text, within a block: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.store import stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Documents of one block of a flight.
BLOCK_ROWS = 20_000
SEED = 7
EPS = 1e-9


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_no, source_size, n_docs, target) of each source, numbered by code point with null last, by water filling.

    Sources in order of their stop by weight: those before the first whose stop is above its share keep their stop, the
    others share the rest by weight. There is one row a source here, never one a document.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    with_weight = per.withColumn("source_no", turn.cast("long")).withColumn("weight", weight).withColumn("stop", F.col("source_size") * float(max_epochs))
    order = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    stops_before = F.coalesce(F.sum("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(every) - stops_before) / weight_from
    ranked = with_weight.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("stop"))
    first_level = F.min(F.when(F.col("free"), F.struct(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    target = F.coalesce(F.least("stop", first_level * F.col("weight")), F.col("stop"))
    return ranked.select("source", "source_no", "source_size", "n_docs", F.when(F.sum("source_size").over(every) > 0, target).otherwise(0.0).alias("target"))


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: totals of prob and of prob * size as before, at most two not 0 or 1.

    Three undecided documents at a time: with two constraints there is a direction in their null space; going along it
    one way or the other (by chance, so that expectations stay) until a probability reaches 0 or 1 decides one of them.
    """
    p = prob.astype(float).tolist()
    s = size.astype(float).tolist()
    draws = rng.random(len(p)).tolist()
    hand: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            hand.append(k)
        else:
            p[k] = round(p[k])
        if len(hand) < 3:
            continue
        a, b, c = hand
        u, v, w = s[b] - s[c], s[c] - s[a], s[a] - s[b]  # orthogonal to (1, 1, 1) and to the three sizes
        if u == v == w == 0:  # equal sizes: a direction in which only counts stay
            u, v, w = 1.0, -1.0, 0.0
        up = down = float("inf")
        for x, d in ((p[a], u), (p[b], v), (p[c], w)):
            if d > 0:
                up, down = min(up, (1 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, x / -d), min(down, (1 - x) / -d)
        move = up if draws[k] * (up + down) < down else -down
        for i, d in ((a, u), (b, v), (c, w)):
            p[i] += move * d
            if p[i] <= EPS:
                p[i] = 0.0
            elif p[i] >= 1 - EPS:
                p[i] = 1.0
        hand = [i for i in hand if EPS < p[i] < 1 - EPS]
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the few documents that the last flight left: of all ways, the one whose words, then whose count, come nearest to what was expected."""
    left = np.flatnonzero((prob > EPS) & (prob < 1 - EPS))
    out = np.round(prob)
    if len(left):
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs((ways - prob[left]) @ size[left])
        count = np.abs((ways - prob[left]).sum(axis=1))
        out[left] = ways[np.lexsort((count, words))[0]]
    return out


def _fly(last: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table["row"]), np.asarray(table["size"])))
        order = order[np.argsort(np.asarray(table["mixed"])[order], kind="stable")]
        table = table.take(pa.array(order))
        prob, size = np.asarray(table["prob"]), np.asarray(table["size"])
        rng = np.random.default_rng([SEED, *(abs(k.as_py() or 0) for k in key)])
        prob = flight(prob, size, rng)
        if last:
            prob = land(prob, size)
        return table.set_column(table.schema.get_field_index("prob"), "prob", pa.array(prob, pa.float64()))

    return run


FLYING = "doc_id long, source string, size long, row long, mixed long, source_no long, prob double"


def balanced_copies(sized: DataFrame, targets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``copies``, how often a document is taken, and its source's source_size and target.

    ``sized`` has doc_id, source, size and a ``row`` that tells rows apart.
    """
    spark = sized.sparkSession
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = targets.withColumn("times", times).select(
        F.col("source").alias("its_source"), "source_size", "target", "n_docs", F.floor("times").alias("whole"), (F.col("times") - F.floor("times")).alias("part"), "source_no"
    )
    joined = sized.join(facts, sized["source"].eqNullSafe(facts["its_source"])).drop("its_source")
    mixed = F.xxhash64("doc_id", "size", F.lit(SEED))
    blocks = F.ceil(F.col("n_docs") / block_rows)
    now = joined.select("doc_id", "source", "size", "row", mixed.alias("mixed"), "source_no", F.col("part").alias("prob"), F.pmod(F.xxhash64(mixed, "row"), blocks).alias("block"))
    most = targets.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    decided = None
    while True:
        last = most <= block_rows
        flown = stored(now.groupBy("source_no", "block").applyInArrow(_fly(last), f"{FLYING}, block long"), "flown")
        open_ = (F.col("prob") > EPS) & (F.col("prob") < 1 - EPS)
        done = flown.filter(~open_).drop("block")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        most = -(-most // block_rows) * 2
        now = flown.filter(open_).withColumn("block", F.floor(F.col("block") / max(1, block_rows // 2)))
    flat = decided.join(facts.drop("its_source", "n_docs", "part"), "source_no")
    return flat.select("doc_id", "source", "size", "row", "source_size", "target", (F.col("whole") + F.col("prob").cast("long")).alias("copies"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and source and copies."""
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("row"))
    sized = stored(sized, "sized")
    targets = stored(source_targets(sized, weights, max_epochs), "targets")
    out = balanced_copies(sized, targets, block_rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mixture itself: each document as many times as it is taken, with the columns of docs.

    Documents are matched to their copies by content (id, source, text's hash); rows that agree in all three are
    interchangeable, so the first ones of them take one copy more where their numbers differ. Texts are shuffled once.
    """
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("row"))
    sized = stored(sized, "sized")
    targets = stored(source_targets(sized, weights, max_epochs), "targets")
    copies = balanced_copies(sized, targets, block_rows)
    key = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("row")]
    names = [f"k{k}" for k in range(len(key))]
    taken = copies.groupBy(*[k.alias(n) for k, n in zip(key, names, strict=True)]).agg(F.min("copies").alias("least"), F.sum("copies").alias("total"), F.count("*").alias("rows"))
    own = docs.select(F.struct("*").alias("document"), "doc_id", "source", F.xxhash64("text").alias("row"))
    own = own.select("document", *[k.alias(n) for k, n in zip(key, names, strict=True)])
    taken = stored(taken.filter("total > 0").withColumn("more", F.col("total") - F.col("least") * F.col("rows")), "taken")
    # texts are streamed past a hash table of the copies; only those of repeated rows whose numbers differ are sorted
    joined = own.join(taken.hint("shuffle_hash"), names)
    nth = F.row_number().over(W.partitionBy(*names).orderBy(*names))
    out = joined.filter("more = 0").select("document", F.col("least").alias("times"))
    if taken.filter("more > 0").limit(1).count():
        differing = joined.filter("more > 0").withColumn("nth", nth)
        out = out.union(differing.select("document", (F.col("least") + (F.col("nth") <= F.col("more")).cast("long")).alias("times")))
    out = out.withColumn("times", F.col("times").cast("int")).filter("times >= 1")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("document.*")
