from collections import Counter

import numpy as np
import pytest

from tessera.llm import embedding_join
from tessera.llm.embedding_join import grid_width, near_duplicates


def brute(rows, threshold=0.98):
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.float32(v).astype(float)
    up, n = list(range(len(rows))), Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / (np.linalg.norm(ok[i]) * np.linalg.norm(ok[j])) >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {(rows[k][0], n[k], rows[find(k)][0]) for k in range(len(rows))}


@pytest.mark.parametrize("options", [{}, {"cell_cap": 30, "piece": 16}, {"grid": 3}])
def test_against_brute_force(spark, sf, options, monkeypatch):
    if "grid" in options:
        monkeypatch.setattr(embedding_join, "grid_width", lambda n, width=options["grid"]: width)
        options = {}
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    for k in range(120):  # a dense group
        rows.append((5000 + k, (np.array(rows[7][1]) + rng.normal(0, 0.02, 64)).tolist(), rows[7][2]))
    rows += [(6000 + k, (2.5 * np.array(rows[k][1])).tolist(), rows[k][2]) for k in range(5)]
    rows += [(6100 + k, rows[3][1], rows[3][2]) for k in range(4)] + [(6200, rows[3][1], None), (6201, None, 1), (6202, [], 1), (6203, [0.0] * 64, 1), (6204, [float("nan")] * 64, 1), (6205, [None, *[1.0] * 63], 1), (6206, [1.0, 2.0], 1), (6207, [2.0, 4.0], 1), (6208, [float("inf")] * 64, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **options).collect()
    rounded = [(i, None if v is None else v, c) for i, v, c in rows]
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == brute(rounded)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_grid_follows_the_largest_label():
    widths = [grid_width(n) for n in (0, 1000, 20_000, 60_000, 10**6, 10**12)]
    assert widths[:2] == [1, 1] and widths == sorted(widths) and widths[-1] == 8


def test_other_columns_do_not_matter(spark):
    rows = [(1, [1.0, 0.0], 1, "x", 2), (1, [1.0, 0.0], 1, "y", 3), (None, [1.0, 0.001], 1, None, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, copies int")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]
