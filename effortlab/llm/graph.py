"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, by_value

by_value(__name__)

#: Edges that a task reduces together.
CHUNK = 1 << 20
EDGES = "u bigint, v bigint"
#: Edges that a task gets at least, where there are more tasks than cores.
TASK = 1 << 17


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each reaches by them."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(place, 2)
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) in, a spanning forest of every chunk of them out: stars (u, smallest), u > smallest."""
    def reduced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        nodes, least = least_reachable(u, v)
        below = least < nodes
        return pa.RecordBatch.from_pydict({"u": nodes[below], "v": least[below]})

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= CHUNK:
            yield reduced(held)
            held, size = [], 0
    if held:
        yield reduced(held)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node that
    has an edge.  ``edges`` has two long columns ``a`` and ``b``; loops, double
    edges and null ends do no harm.

    Every task first reduces its edges to a spanning forest, so that at most a
    node's number of edges leaves it.  Then two kinds of star contraction take turns:
    every node hands its larger neighbours to its smallest one (large star),
    then its smaller neighbours and itself (small star), and tasks reduce what
    they made to forests again.  It ends when every node either has one
    neighbour that is smaller or only larger ones, which is seen while a large
    star is written.  Rounds grow with the logarithm of the graph.  A star moves
    one minimum per node, combined map-side, and meets the edges in a join; a
    hub's edges may be split there.  Every half round is written, so a lost
    executor costs no more than that; by as many tasks as there are cores, or as
    its edges fill, however many partitions a shuffle has.
    """
    now = scratch.put(edges.selectExpr("a as u", "b as v").filter("u != v").mapInArrow(_forest, EDGES), f"{name}-0")
    cores = scratch.spark.sparkContext.defaultParallelism
    for k in range(1, 100 if now.limit(1).count() else 1):
        tasks = max(cores, now.count() // TASK)
        both = now.unionByName(now.selectExpr("v as u", "u as v"))
        below = F.when(F.col("v") < F.col("u"), F.col("v"))
        low = both.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(below).alias("last"))
        seen = Observation()
        moving = (F.col("least") < F.col("u")) & ((F.col("most") > F.col("u")) | (F.col("last") != F.col("least")))
        low = low.observe(seen, F.coalesce(F.max(moving), F.lit(False)).alias("moving"))
        large = (both.filter("v > u").join(low.select("u", F.least("least", "u").alias("m")), "u")
                 .selectExpr("v as u", "m as v").coalesce(tasks).mapInArrow(_forest, EDGES))
        large = scratch.put(large, f"{name}-{k}-l")
        if not seen.get["moving"]:
            scratch.drop(f"{name}-{k}-l")
            break
        # Forests are stars, so u > v on every row.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.selectExpr("v as u", "m as v").unionByName(least.selectExpr("u", "m as v")).filter("u != v")
        now = scratch.put(small.coalesce(tasks).mapInArrow(_forest, EDGES), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-l")
        if k == 99:
            raise RuntimeError("components did not settle")
    # The smaller end of every edge is the root of a star.
    return now.selectExpr("u as node", "v as component").unionByName(now.selectExpr("v as node", "v as component")).distinct()
