"""Hard negatives by the threshold algorithm over sorted candidate lists.

Vectors become integers, so scores (inner products) are exact.  Candidates are
dealt to blocks of bounded size; a block keeps, for every dimension, its
candidates sorted by their component.  For an anchor, the list of a dimension
is read from its large end where the anchor's component is positive and from
its small end where it is negative (not at all where it is zero).  Every
candidate met in any list is scored whole by random access.  What no list has
shown yet scores at most the threshold: the anchor's components times the
components last read.  Reading stops once the threshold is strictly below what
each window still asks for: its k-th best score, or its lower end.

Two searches of this kind: positives (same label, one open window), then
negatives (other labels, one window for each positive's score).  Blocks meet
groups of anchors, both of bounded size, and return at most k rows a window;
the best of all blocks follow by a top-k per window, so no result depends on
how rows are dealt.  An anchor reads every block, as an exact search must; the
grid says which task does so.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part.  A row without id is a candidate, last among equals,
and no anchor.  Rows that repeat an id are rows like any others: each is a
candidate, and each is an anchor with results of its own.  Of vectors of
different lengths the shorter one counts as filled up with zeros.  Scores must
fit 63 bits: larger components stop the job.  Empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_value

by_value(__name__)

#: Components of the candidates of a block and of the anchors of a group: what one task holds.
BLOCK_VALUES = 1 << 22
GROUP_VALUES = 1 << 18
#: Entries read of each list before the threshold is first looked at.
FIRST_DEPTH = 32
OPEN = 1 << 62


def quantise(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             scale: float = 256.0, relabel: Column | None = None) -> DataFrame:
    """(id, label, q): ``floor(scale * x)`` of every component as a long, for
    rows that take part.  ``relabel`` is an expression over the input."""
    known = vectors.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label) if relabel is None else relabel).alias("label"),
                           F.col(vector).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    q = F.transform("e", lambda x: F.floor(x * scale).cast("bigint"))
    large = F.exists("e", lambda x: F.abs(x * scale) >= float(OPEN))
    refused = F.raise_error(F.lit("a component is too large for exact scores")).cast("array<bigint>")
    return (known.filter(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
            .select("id", "label", F.when(large, refused).otherwise(q).alias("q")))


class Lists:
    """Candidates of a block in sorted lists, one per dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.rows, self.ids, self.labels, self.matrix = rows, ids, labels, matrix
        self.order = np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32)       # list of each dimension
        self.sorted = np.take_along_axis(matrix, self.order.T.astype(np.int64), axis=0).T
        self.widest = int(np.abs(matrix).max(initial=0))

    def search(self, anchor: np.ndarray, eligible: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[int]]:
        """Positions of the best ``k`` eligible candidates by (score, smaller
        id) whose score lies in each window (both ends count)."""
        n, dims = self.matrix.shape
        if dims * self.widest * int(np.abs(anchor).max(initial=0)) >= OPEN:
            raise ValueError("scores do not fit 63 bits")
        used = np.flatnonzero(anchor)
        signed, up = anchor[used], anchor[used] > 0
        seen = np.zeros(n, bool)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        depth, step = 0, FIRST_DEPTH
        while True:
            to = min(n, depth + step) if len(used) else n
            met = np.zeros(n, bool)
            if len(used):
                met[self.order[used[up], n - to:n - depth]] = True          # from the large end
                met[self.order[used[~up], depth:to]] = True                 # from the small end
            else:
                met[:] = True                                               # a zero anchor scores 0 with all
            new = np.flatnonzero(met & ~seen & eligible)
            seen |= met
            scores = self.matrix[new] @ anchor
            for w, (low, high) in enumerate(windows):
                inside = (scores >= low) & (scores <= high)
                if inside.any():
                    s = np.concatenate([best[w][0], scores[inside]])
                    p = np.concatenate([best[w][1], new[inside]])
                    if len(s) > 4 * k + 64:                                  # only what reaches the k-th score is sorted
                        kth = np.partition(s, len(s) - k)[len(s) - k]
                        s, p = s[s >= kth], p[s >= kth]
                    first = np.lexsort((self.rows[p], self.ids[p], -s))[:k]
                    best[w] = s[first], p[first]
            depth, step = to, step * 2
            if depth == n:
                break
            last = np.where(up, self.sorted[used, n - depth], self.sorted[used, depth - 1])
            threshold = int(signed @ last)
            if all(threshold < (max(low, int(s[-1])) if len(s) == k else low)
                   for (low, _), (s, _) in zip(windows, best, strict=True)):
                break
        return [p.tolist() for _, p in best]


def _matrix(column: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Rows of an array column, filled up with zeros to the longest (or ``dims``)."""
    rows = column.combine_chunks()
    ends = rows.offsets.to_numpy(zero_copy_only=False)
    lengths, values = np.diff(ends), rows.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), max(int(lengths.max(initial=0)), dims or 0)), np.int64)
    held = np.arange(out.shape[1]) < lengths[:, None]
    out[held] = values[ends[0]:ends[-1]]
    return out


def _longs(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy()


FOUND = "a bigint, w int, score bigint, r bigint, id bigint"


def _meet(k: int, low: tuple[int, int] | None, high: tuple[int, int] | None):
    """Search of one group of anchors in one block: rows of their label (no
    ends given), or rows of other labels, a window for each of their scores."""
    same = low is None

    def run(block: pa.Table, group: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int | None]] = []
        if block.num_rows and group.num_rows:
            asked = _matrix(group["q"])
            matrix = _matrix(block["q"], asked.shape[1])
            labels, kinds = block["label"].to_pylist(), group["label"].to_pylist()
            code = {x: i for i, x in enumerate(set(labels) | set(kinds))}
            label = np.array([code[x] for x in labels])
            ids, rows = _longs(block["id"], np.iinfo(np.int64).max), _longs(block["r"])
            lists: dict[int, Lists] = {}
            for a, kind, anchor, scores in zip(_longs(group["r"]).tolist(), kinds, asked, group["scores"].to_pylist()):
                kind, anchor = code[kind], np.pad(anchor, (0, matrix.shape[1] - len(anchor)))
                part = kind if same else -1                      # positives have lists of their label
                if part not in lists:
                    mine = label == kind if same else np.ones(len(label), bool)
                    lists[part] = Lists(rows[mine], ids[mine], label[mine], matrix[mine])
                here = lists[part]
                eligible = here.rows != a if same else here.labels != kind
                windows = [(-OPEN, OPEN)] if same else [(-(-x["p"] * low[0] // low[1]), x["p"] * high[0] // high[1]) for x in scores]
                for w, found in enumerate(here.search(anchor, eligible, windows, k)):
                    for p in found:
                        i = int(here.ids[p])
                        out.append((a, 0 if same else scores[w]["w"], int(here.matrix[p] @ anchor), int(here.rows[p]),
                                    None if i == np.iinfo(np.int64).max else i))
        names = ["a", "w", "score", "r", "id"]
        kinds_out = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(zip(names, kinds_out))})

    return run


def _search(candidates: DataFrame, anchors: DataFrame, k: int, blocks: int, groups: int,
            low: tuple[int, int] | None = None, high: tuple[int, int] | None = None) -> DataFrame:
    """(a, w, rank, score, r, id): the best ``k`` of all candidates in every
    window of every anchor.  ``anchors`` has r, label, q and ``scores``."""
    dealt = candidates.select("r", "id", "label", "q", F.pmod(F.xxhash64("r"), F.lit(blocks)).cast("int").alias("block"),
                              F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asking = anchors.select("r", "label", "q", "scores", F.pmod(F.xxhash64("r", F.lit("anchor")), F.lit(groups)).cast("int").alias("group"),
                            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = (dealt.groupBy("block", "group").cogroup(asking.groupBy("block", "group"))
             .applyInArrow(_meet(k, low, high), FOUND))
    order = Window.partitionBy("a", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "r")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
         relabel: Column | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 5,
         low: tuple[int, int] = (80, 100), high: tuple[int, int] = (100, 100),
         block_values: int = BLOCK_VALUES, group_values: int = GROUP_VALUES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``.  A negative's score s
    and its positive's score p satisfy ``low[0] * p <= low[1] * s`` and
    ``high[1] * s <= high[0] * p``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = quantise(vectors, id_col=id_col, vector=vector, label=label, scale=scale, relabel=relabel)
    rows = scratch.put(rows.withColumn("r", F.monotonically_increasing_id()), "rows")
    anchors = spark.read.schema(rows.schema).parquet(scratch.path("rows")).filter(F.col("id").isNotNull() & is_anchor)
    n, m, dims = rows.agg(F.count("*"), F.count_if(F.col("id").isNotNull() & is_anchor), F.max(F.size("q"))).first()
    blocks = max(-(-n * max(dims or 0, 1) // block_values), min(spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    groups = max(-(-m * max(dims or 0, 1) // group_values), 1)

    none = F.array().cast("array<struct<w:int,p:bigint>>")
    near = _search(rows, anchors.withColumn("scores", none), positives, blocks, groups)
    near = scratch.put(near.selectExpr("a", "rank as w", "score as p", "id as positive_id"), "positives")
    asked = near.groupBy(F.col("a").alias("r")).agg(F.collect_list(F.struct("w", "p")).alias("scores"))   # `positives` each at most
    hard = _search(rows, anchors.join(asked, "r"), negatives, blocks, groups, low, high)
    return (hard.withColumnRenamed("id", "negative_id").join(near, ["a", "w"])
            .join(anchors.selectExpr("r as a", "id as anchor_id"), "a")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    F.col("p").alias("positive_score"), F.col("score").alias("negative_score")))
