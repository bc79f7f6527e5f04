"""Connected components against a plain search; shapes that are hard for it; odd edges."""

import random

import numpy as np
import pytest

from effortlab.llm import graph
from effortlab.llm.common import Scratch


def plain(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def got(spark, edges, parts=6):
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(parts)
    rows = graph.components(df, Scratch(spark, "test-graph"), "g").collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_shapes(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(chunk)
    chain = [(i, i + 1) for i in range(10_000)]
    star = [(20_000 + i, 50_000) for i in range(5_000)] + [(60_000, 60_000 + i) for i in range(1, 5_000)]
    names = list(range(100_000, 103_000))
    rng.shuffle(names)
    shuffled = list(zip(names, names[1:]))                       # a chain whose names say nothing
    some = [(rng.randrange(200_000, 204_000), rng.randrange(200_000, 204_000)) for _ in range(2_500)]
    edges = chain + star + shuffled + some
    rng.shuffle(edges)
    assert got(spark, edges) == plain(edges)


def test_odd_edges(spark):
    edges = [(1, 1), (None, 3), (4, None), (None, None), (5, 6), (6, 5), (5, 6), (-7, 6), (-(1 << 62), 1 << 62), (8, 8), (8, 9), (9, 8)]
    assert got(spark, edges) == plain(edges) == {5: -7, 6: -7, -7: -7, -(1 << 62): -(1 << 62), 1 << 62: -(1 << 62), 8: 8, 9: 8}
    assert got(spark, [(1, 1), (None, 2)]) == {} and got(spark, []) == {}


def test_forest_keeps_what_is_connected():
    rng = np.random.default_rng(5)
    for n in (2, 30, 400):
        u, v = rng.integers(0, n, n), rng.integers(0, n, n)
        nodes, least = graph.least_reachable(u, v)
        want = plain([(int(a), int(b)) for a, b in zip(u, v)])
        assert {int(a): int(b) for a, b in zip(nodes, least) if int(a) in want} == want
