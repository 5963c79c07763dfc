import random

import pytest

from tessera.llm.components import connected_components


@pytest.mark.parametrize("local", [1 << 21, 3])
def test_components(spark, local):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 530)] + [(7, 7), (900, 900)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b", local).collect()}
    want = {k: find(k) for k in up if find(k) != k}
    assert {k: v for k, v in got.items() if k != v} == want
