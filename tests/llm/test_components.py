import random

import numpy as np
import pytest
from twinlathe.llm import components as co
from twinlathe.llm.storage import Scratch


def smallest(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def test_connected_points():
    rng = random.Random(1)
    for n, m in ((1, 0), (10, 6), (200, 150), (200, 900)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        label = co.connected(n, *np.array(edges, np.int64).reshape(-1, 2).T)
        expected = smallest(edges)
        assert label.tolist() == [expected.get(i, i) for i in range(n)]
    path = np.random.default_rng(0).permutation(3000)
    assert (co.connected(3000, path[:-1], path[1:]) == 0).all()


@pytest.mark.parametrize("local", [1 << 20, 40])
def test_components_of_long_and_binary_nodes(spark, monkeypatch, local):
    """Chains, stars and random pieces; by one task, and by rounds over many."""
    monkeypatch.setattr(co, "LOCAL", local)
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 501 + k) for k in range(50)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (500, 501)]
    expected = {k: v for k, v in smallest([e for e in edges if e[0] != e[1]]).items()}
    got = co.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r["node"]: r["root"] for r in got} == expected and len(got) == len(expected)
    if local > 40:
        as_bytes = spark.createDataFrame([(a.to_bytes(16, "big"), b.to_bytes(16, "big")) for a, b in edges], "a binary, b binary")
        got = co.components(as_bytes, Scratch(spark, "test")).collect()
        assert {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in got} == expected
        assert co.components(as_bytes.limit(0), Scratch(spark, "test")).count() == 0
