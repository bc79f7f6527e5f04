"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are chosen far apart from a bounded sample of
``SAMPLE`` vectors.  Every vector is described by its ``near`` nearest pivots in
order of nearness, and filed under each of them in inverted lists per label.  Two
vectors of a list that share at least ``shared`` pivots are verified by their
cosine in double precision; the list of their smallest shared pivot does it, so
no pair is counted twice.

Equal vectors of a label are one class with a weight; only classes are filed.
What leaves a list is linear in its size (per class the weight of its links, and
a spanning forest of them), never its pairs.  A list of more than ``BLOCK``
classes is dealt into chunks, and each pair of chunks is one task's work.  The
number of pivots grows with the square root of the number of classes, which keeps
lists short.

The index is approximate: a pair with too few shared pivots is missed.  The tests
measure its recall against brute force (0.9 is asked for).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, link with nothing: no links, their own
component, kept.  Vectors of different lengths never link.  Repeated rows are
links of each other.  A null id never names a component; such a row is kept only
if its component has no id at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_value
from .graph import components

by_value(__name__)

#: Vectors from which the pivots are chosen.
SAMPLE = 4096
#: Classes of a list that meet in one task; a task holds two such chunks.
BLOCK = 1024


def choose_pivots(x: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` unit vectors of ``x``, each as far as can be from those before."""
    if not len(x):
        return x
    chosen, best = [0], x @ x[0]
    while len(chosen) < min(m, len(x)):
        i = int(best.argmin())
        if best[i] > 1 - 1e-9:
            break
        chosen.append(i)
        best = np.maximum(best, x @ x[i])
    return x[chosen]


def _unit(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        r = np.asarray(r, float)[:width]
        out[i, :len(r)] = r
    with np.errstate(over="ignore", invalid="ignore"):
        out /= np.maximum(np.abs(out).max(axis=1, keepdims=True, initial=0), 1e-300)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no product of theirs overflows or vanishes; cosines stay as they are."""
    if not x.size:
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :near]


def list_links(a: dict, b: dict | None, pivot: int, m: int, shared: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (positions in ``a``, in ``b``) of one list; ``b`` None: within ``a``."""
    def marks(side: dict) -> np.ndarray:
        out = np.zeros((len(side["perm"]), m), np.float32)
        out[np.arange(len(out))[:, None], side["perm"]] = 1
        return out

    ma, mb = marks(a), marks(b or a)
    hit = ma @ mb.T >= shared
    if pivot:
        hit &= (ma[:, :pivot] @ mb[:, :pivot].T) == 0
    if b is None:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    va, vb = a["vec"], (b or a)["vec"]
    keep = []
    for lo in range(0, len(i), 65536):                  # a stride of candidates at a time
        ii, jj = i[lo:lo + 65536], j[lo:lo + 65536]
        cos = np.einsum("ij,ij->i", va[ii], vb[jj]) / ((a["norm"])[ii] * ((b or a)["norm"])[jj])
        keep.append(lo + np.flatnonzero(cos >= cosine))
    at = np.concatenate([*keep, np.empty(0, np.int64)]).astype(np.int64)
    return i[at], j[at]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position joined to each of ``n`` positions by the links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new[new]
    return root


def _file(classes: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(pivots)          # at most MOST_PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            perm = nearest_pivots(_unit(batch.column("embedding").to_pylist(), shared.value.shape[1]), shared.value, near)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("node", "label", "weight", "embedding")]
                + [pa.array(perm.tolist(), pa.list_(pa.int32()))], ["node", "label", "weight", "embedding", "perm"])

    return classes.select("node", "label", "weight", "embedding").mapInArrow(
        run, "node bigint, label string, weight bigint, embedding array<double>, perm array<int>")


def _meet(listed: DataFrame, m: int, shared: int, cosine: float) -> DataFrame:
    """Per class of a list with links: the weight of its links there, and a
    class that it is joined to."""

    def solve(rows: list[dict]) -> list[tuple[int, int, int]]:
        out, by_size = [], {}
        for r in rows:
            by_size.setdefault(len(r["embedding"]), []).append(r)
        for same in by_size.values():
            two = same[0]["i"] != same[0]["j"]
            sides = []
            for part in ([[r for r in same if r["chunk"] == same[0][c]] for c in ("i", "j")] if two else [same]):
                vec = _scaled(np.array([r["embedding"] for r in part], float))
                sides.append({"vec": vec, "perm": np.array([r["perm"] for r in part], np.int64),
                              "norm": np.sqrt(np.einsum("ij,ij->i", vec, vec)) if len(part) else None, "rows": part})
            if any(not s["rows"] for s in sides):
                continue
            i, j = list_links(sides[0], sides[1] if two else None, same[0]["pivot"], m, shared, cosine)
            everyone = [r for s in sides for r in s["rows"]]
            j = j + len(sides[0]["rows"]) * two
            w = np.array([r["weight"] for r in everyone], float)
            total = np.bincount(i, w[j], len(everyone)) + np.bincount(j, w[i], len(everyone))
            root = _forest(len(everyone), i, j)
            out += [(everyone[k]["node"], everyone[int(root[k])]["node"], int(total[k])) for k in np.flatnonzero(total)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "b": [r[1] for r in rows], "links": [r[2] for r in rows]})

        key, held = None, []
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                own = (r["label"], r["pivot"], r["i"], r["j"])
                if own != key:
                    found += solve(held) if len(held) > 1 else []
                    key, held = own, []
                held.append(r)
            if found:
                yield pack(found)
        found = solve(held) if len(held) > 1 else []
        if found:
            yield pack(found)

    return (listed.repartition("label", "pivot", "i", "j").sortWithinPartitions("label", "pivot", "i", "j")
            .mapInArrow(run, "a bigint, b bigint, links bigint"))


#: Pivots are at least FEWEST_PIVOTS and at most MOST_PIVOTS.
FEWEST_PIVOTS, MOST_PIVOTS = 64, 4096


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = 0.93, near: int = 8, shared: int = 3) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
                          F.col(vector).cast("array<double>").alias("embedding"))
    sound = (F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
             & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn(
        "key", F.when(F.col("sound"), F.sha2(F.concat_ws("|", "label", F.concat_ws(",", F.transform(
            "embedding", lambda x: (x + F.lit(0.0)).cast("string")))), 256)))
    rows = scratch.put(rows, "rows")
    light = rows.select("id", "key")
    classes = rows.filter("sound").groupBy("key").agg(
        F.min("id").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding"))
    # A class without any id takes part under a negative stand-in that names nothing.
    classes = scratch.put(classes.withColumn("node", F.coalesce("node", -F.abs(F.xxhash64("key")) - 1)), "classes")

    n = classes.count()
    sample = np.empty((0, 1))
    if n:
        taken = [r["embedding"] for r in classes.orderBy(F.xxhash64("key")).limit(SAMPLE).select("embedding").collect()]
        sample = _unit(taken, max(map(len, taken)))
    pivots = choose_pivots(sample, min(MOST_PIVOTS, max(FEWEST_PIVOTS, math.isqrt(n))))
    m = len(pivots)
    if m:
        filed = scratch.put(_file(classes, pivots, near), "filed")
        listed = filed.withColumn("pivot", F.explode("perm"))
        long = filed.select("label", F.explode("perm").alias("pivot")).groupBy("label", "pivot").agg(
            F.ceil(F.count("*") / BLOCK).alias("chunks")).filter("chunks > 1")
        listed = (listed.join(long, ["label", "pivot"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("bigint")))
                  .withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)"))
                  .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
                  .withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")))
        links = scratch.put(_meet(listed, m, min(shared, m), cosine), "links")
        count = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        joined = components(links.select("a", "b"), scratch, "joined")
        named = classes.select("key", "node", "weight").join(count, "node", "left").join(joined, "node", "left")
    else:
        named = classes.select("key", "node", "weight", F.lit(None).cast("bigint").alias("links"),
                               F.lit(None).cast("bigint").alias("component"))
    named = named.withColumn("component", F.coalesce("component", "node"))
    # Stand-ins give way to the smallest true id of their component.
    true = named.filter("node >= 0").groupBy("component").agg(F.min("node").alias("component_id"))
    named = named.join(true, "component", "left").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return light.join(named, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", F.when(F.col("key").isNull(), F.col("id"))).alias("component_id")).withColumn(
        "kept", F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(
            F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
