"""Hard negatives: equal to plain search over all rows, whatever the blocks; odd rows; the stop really comes early."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from effortlab.llm import hard_negatives as H
from effortlab.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, ID string"


def plain(rows, every=3, k=5):
    """Rows of (anchor, positive, rank, negative, scores) by looking at every pair."""
    known = []
    for place, (i, e, label, _) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        known.append((place, i, label, [math.floor(256 * x) for x in e]))
    order = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0, f[2]))
    out = []
    for place, i, label, q in known:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), j, other, y) for other, j, y, v in known if other != place]
        for ps, p, _, _ in order([s for s in scored if s[3] == label])[:k]:
            fitting = [s for s in scored if s[3] != label and 80 * ps <= 100 * s[0] <= 100 * ps]
            out += [(i, p, r, n, ps, ns) for r, (ns, n, _, _) in enumerate(order(fitting)[:k], 1)]
    return out


def made(n, dims, labels, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = centres[i % 4]
        rows.append((i - 5, [x + rng.gauss(0, 0.6) for x in c], rng.randrange(labels), "x"))
    return rows


def key(rows):
    return sorted((tuple(-1 << 40 if x is None else x for x in r) for r in rows))


@pytest.mark.parametrize("block_values,group_values", [(1 << 22, 1 << 18), (200, 40), (8, 8)])
def test_equals_plain_search(spark, block_values, group_values):
    rows = made(90, 8, 3, 1)
    rows += [(7, rows[3][1], 1, "copy"), (12, rows[12][1], 2, "again"), (12, rows[12][1], 2, "again"), (None, rows[9][1], 0, "no id")]
    got = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 3 == 0, block_values=block_values, group_values=group_values)
    got = key(map(tuple, got.collect()))
    assert got and got == key(plain(rows))


def test_odd_rows(spark):
    rows = made(40, 4, 2, 2)
    rows += [(300, None, 1, ""), (303, [1.0, None, 2.0, 3.0], 1, ""), (306, [1.0, float("nan"), 0.0, 0.0], 0, ""),
             (309, [float("inf"), 0.0, 0.0, 0.0], 0, ""), (312, [0.5, 0.5, 0.5, 0.5], None, ""), (315, [], 1, ""),
             (318, [0.0] * 4, 0, ""), (321, [2.0, 1.0], 1, ""), (324, [-1.0, 3.0, 0.5, 0.25, 4.0], 0, ""),
             (327, [1.0, 1.0, 1.0, 1.0], 99, "no positive")]
    filled = [(i, None if e is None else e + [0.0] * (5 - len(e)), y, x) for i, e, y, x in rows]
    got = key(map(tuple, H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 3 == 0, block_values=50).collect()))
    assert got == key(plain(filled))
    assert H.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 3 == 0).count() == 0
    assert H.mine(spark.createDataFrame(rows[5:6], SCHEMA), F.col("id") % 3 == 0).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0], i % 2, "") for i in range(60)]
    got = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") == 30, block_values=14).collect()
    assert {r.positive_id for r in got} == {0, 2, 4, 6, 8}
    assert {(r.rank, r.negative_id) for r in got} == {(1, 1), (2, 3), (3, 5), (4, 7), (5, 9)}


def test_too_large_components_stop_the_job(spark):
    rows = [(0, [1e18, 1.0], 0, ""), (1, [1e18, 1.0], 0, "")]
    with pytest.raises(Exception, match="too large|63 bits"):
        H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).collect()


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    n, dims = 20_000, 6
    matrix = rng.integers(-60, 60, (n, dims))
    matrix[:40] *= 4
    lists = H.Lists(np.arange(n), np.arange(n), np.zeros(n, int), matrix)
    scored = []

    class Counted(np.ndarray):
        def __getitem__(self, i):
            out = super().__getitem__(i)
            if isinstance(i, np.ndarray):
                scored.append(len(i))
            return out

    lists.matrix = matrix.view(Counted)
    anchor = np.array([90, -80, 70, 0, 60, -50])
    found = lists.search(anchor, np.ones(n, bool), [(-H.OPEN, H.OPEN)], 5)[0]
    every = matrix @ anchor
    want = np.lexsort((np.arange(n), -every))[:5].tolist()
    assert found == want and sum(scored) < n // 4


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(queries.ORACLE["op13_hard_negatives"]).fetchall()
    got = queries.QUERIES["op13_hard_negatives"](spark, sf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
