"""Language identification: gradients, held-out accuracy, edges. Token counts: against one token at a time."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id, token_counts

DOCS = "doc_id long, text string, lang string"


def test_gradients():
    net = language_id.ByteGru(["a", "b", "c"], hidden=3)
    rng = np.random.RandomState(0)
    x, y, real = rng.randint(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((6, 4), np.float32)
    real[5, 0] = 0
    _, grad = net.gradients(x, y, real)
    for name, w in net.w.items():
        at = np.unravel_index(np.abs(grad[name]).argmax(), w.shape)
        losses = []
        for step in (1e-2, -1e-2):
            w[at] += step
            losses.append(net.gradients(x, y, real)[0])
            w[at] -= step
        assert grad[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.05, abs=2e-4)


def test_forward_by_one_byte_at_a_time():
    """The network's states, gate by gate, and a document's means over its bytes."""
    net = language_id.ByteGru(["a", "b", "c"], hidden=3, seed=9)
    text = "Ünï text that is longer than one segment of the network, so that the states start anew in the middle of it. End"
    data, steps = text.encode(), language_id.STEPS
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    want = []
    for begin in range(0, len(data), steps):
        part = data[begin : begin + steps]
        padded = list(part.ljust(steps, b" "))
        states = []
        for d, seen in ((0, padded), (1, padded[::-1])):
            h, own = np.zeros(3), []
            for byte in seen:
                gates = sigmoid(2 * (net.w["gates_in"][d][byte] + h @ net.w["gates"][d]))
                update, reset = gates[:3], gates[3:]
                new = np.tanh(net.w["new_in"][d][byte] + (reset * h) @ net.w["new"][d])
                h = (1 - update) * h + update * new
                own.append(h)
            states.append(own if d == 0 else own[::-1])
        for t in range(len(part)):
            logits = states[0][t] @ net.w["out"][0] + states[1][t] @ net.w["out"][1] + net.w["bias"]
            want.append(np.exp(logits) / np.exp(logits).sum())
    got = net.document_probabilities(pa.array([text, None, ""]))
    assert got[0] == pytest.approx(np.mean(want, axis=0), rel=1e-4) and (got[1:] == 0).all()


def test_very_long_text(spark):
    """Every byte counts, and training draws a bounded part of a text."""
    docs = spark.createDataFrame([(1, "der die das und " * 60_000, "de"), (3, "the and of with " * 60_000, "en"), (4, "the and of with " * 30_000 + "der die das und " * 40_000, None)], DOCS)
    got = {r.doc_id: r for r in language_id.language_ids(docs).collect()}
    assert [got[k].lang_pred for k in (1, 3, 4)] == ["de", "en", "de"]


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(50001, None, "en"), (50002, "", None), (50003, "123 ... 45", "de"), (50004, "a", None), (None, "le la de", None)], DOCS)
    got = language_id.language_ids(docs.select("doc_id", "text", "lang").union(odd)).toPandas()
    assert len(got) == 1005 and got.score.between(0, 1).all()
    und = got[got.doc_id.isin([50001, 50002, 50003])]
    assert (und.lang_pred == "und").all() and (und.score == 0).all()
    assert (got[~got.doc_id.isin([50001, 50002, 50003])].lang_pred != "und").all()
    both = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    test = both[both.held_out]
    assert (test.lang_pred == test.lang).mean() > 0.95
    assert all(h == (zlib.crc32(str(int(d)).encode()) % 4 == 2) for d, h in zip(both.doc_id, both.held_out, strict=True))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], DOCS)
    assert {(r.lang_pred, r.score) for r in language_id.language_ids(docs).collect()} == {("und", 0.0)}
    assert language_id.language_ids(docs.limit(0)).collect() == []


def by_token(data: bytes, ends, rule, lengths):
    counts, at, crossing = [0.0] * len(ends), 0, 0
    home = lambda byte: next(k for k, e in enumerate(ends) if byte < e)
    for n in lengths:
        owners = [home(b) for b in range(at, at + n)]
        crossing += len(set(owners)) > 1
        if rule == "start":
            counts[owners[0]] += 1
        elif rule == "end":
            counts[owners[-1]] += 1
        elif rule == "majority":
            counts[max(sorted(set(owners)), key=owners.count)] += 1
        else:
            for k in set(owners):
                counts[k] += owners.count(k) / n
        at += n
    return counts, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(rule):
    rng = np.random.RandomState(1)
    for _ in range(40):
        lengths = rng.randint(1, 7, rng.randint(1, 20))
        size = int(lengths.sum())
        ends = sorted({*rng.randint(1, size + 1, 4).tolist(), size})
        got, crossing = token_counts.attribute(np.cumsum(lengths), np.array(ends), rule)
        want, n = by_token(b"", ends, rule, lengths.tolist())
        assert got.tolist() == pytest.approx(want) and crossing == n


def test_line_tokens(spark, sf):
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9000, None), (9001, ""), (9002, "\n\nab\n"), (9003, "<|endoftext|> ünï\n" * 3), (9003, "x" * 3000)], "doc_id long, text string"))
    encoding = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(), special_tokens={})
    got = token_counts.line_tokens(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        sizes = [len(encoding.encode_ordinary(t or "")) for t in texts[r.doc_id]]
        assert r.n_tokens in sizes and sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections
    by = {r.doc_id: r for r in got}
    assert by[9000].n_sections == by[9001].n_sections == 0 and by[9002].n_sections == 3


def test_field_tokens(spark):
    rows = spark.createDataFrame([(1, "a title", None, "body text here"), (2, None, None, None)], "id long, a string, b string, c string")
    got = {r.id: r for r in token_counts.field_tokens(rows, ["a", "b", "c"], "id").collect()}
    assert all(len(r.field_tokens) == 3 and sum(r.field_tokens) == r.n_tokens for r in got.values())
    with pytest.raises(ValueError):
        token_counts.field_tokens(rows, ["a"], "id", rule="middle")
