"""Pivot index: recall against brute force, counts and components, odd rows."""

import math

import numpy as np
import pytest

from effortlab.llm import pivot_index


def brute_force(ids, x, labels, cosine=0.93):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = {i: set() for i in ids}
    for a in range(len(ids)):
        for b in np.flatnonzero((unit @ unit[a] >= cosine) & (labels == labels[a])):
            if b != a:
                links[ids[a]].add(ids[int(b)])
    component = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in component:
                component[j] = i
                todo += links[j]
    return links, component


@pytest.mark.parametrize("block", [1024, 25])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(250, 32))
    x = np.concatenate([base, base[:150] + rng.normal(size=(150, 32)) * rng.random((150, 1)) * 0.35,
                        base[:30].repeat(4, axis=0) + rng.normal(size=(120, 32)) * 0.05, base[:40]])
    labels = rng.integers(0, 2, len(x))
    labels[-40:] = labels[:40]
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame(list(zip(ids, x.tolist(), labels.tolist(), strict=True)), "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in pivot_index.near_duplicates(df).collect()}
    links, component = brute_force(ids, x, labels)
    assert len(got) == len(ids)
    found, there = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert there > 300 and 0.9 * there <= found <= there           # recall; never a link too many
    for i, r in got.items():
        assert r.n_links <= len(links[i]) and r.kept == (r.component_id == i)
    if found == there:
        assert {i: r.component_id for i, r in got.items()} == component


def test_recall_on_the_table():
    pytest.importorskip("duckdb")
    import duckdb
    r = duckdb.connect().execute("SELECT vec_id, embedding, label FROM '/root/testdata/sf0.1/embeddings.parquet' "
                                 "WHERE embedding IS NOT NULL AND label IS NOT NULL").fetchnumpy()
    x = np.array([np.asarray(v, float) for v in r["embedding"]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(1)
    x = np.concatenate([x, x[:500] + rng.normal(size=(500, x.shape[1])) * 0.03])         # and near copies, around the limit
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = pivot_index.choose_pivots(x[rng.permutation(len(x))[:pivot_index.SAMPLE]], max(64, math.isqrt(len(x))))
    perm = pivot_index.nearest_pivots(x, pivots, 8)
    pairs = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    shared = [len(np.intersect1d(perm[a], perm[b])) for a, b in pairs]
    assert len(pairs) >= 300 and np.mean(np.array(shared) >= 3) >= 0.97


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.1], 0), (4, [1.0, 0.0], 1),
            (5, [1.0, 0.0], None), (6, None, 0), (7, [0.0, 0.0], 0), (8, [1.0, nan], 0), (9, [inf, 0.0], 0),
            (10, [1.0, None], 0), (11, [], 0), (12, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [0.0, 1.0], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, kept string")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in pivot_index.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (0, 4, 1, False),
                          (0, 0, 0, True), *alone])
    assert pivot_index.near_duplicates(df.limit(0)).count() == 0


def test_very_large_and_very_small_components(spark):
    """Finite vectors whose products overflow or vanish link by their cosine all the same."""
    rows = [(1, [1e200, 0.0], 0), (2, [1e200, 1e198], 0), (3, [1e-200, 1e-202], 0), (4, [0.0, 1e200], 0), (5, [1.7e308, 1.7e308], 0),
            (6, [5e-324, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_duplicates(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (0, 4), 5: (0, 5)}
