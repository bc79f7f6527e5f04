"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

A text is lower-cased, everything but letters, marks and digits becomes a
blank, and each of its n-grams (3 to 6 characters, word ends included) is a
64-bit code: a polynomial of its code points, different for each length.
From labelled texts come, per n-gram, the counts of documents of either
class; the log ratio of the classes' smoothed shares scales the n-gram's 0/1
feature, and a regularised logistic regression is fitted on the scaled
features.  N-grams whose ratio is not clearly off zero are left out of the
model, so a long text does not gather chance weight.

Counting runs in Spark over a bounded sample of labelled rows (``per_class`` of
each label, smallest id hashes first), weighted back to the label counts of all
rows.  Scoring is one pass over the documents where they are scanned; what is
broadcast is bounded by ``max_features``.

Defined results: a null or empty text has no n-grams and gets the score of the
intercept.  Rows without a label, with a null one or with both labels teach
nothing; without any usable label every score is 0.5.  Other columns pass
through, columns named like a result are replaced, repeated rows are scored
each.  Texts are read whole, in strides: memory follows the stride, not the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, by_value, labels_of, tidy, with_fields

by_value(__name__)

ORDERS = (3, 4, 5, 6)
#: Characters that are looked at together.
STRIDE = 1_000_000
_FACTOR = np.uint64(0x9E3779B185EBCA87)
_BLANK = np.uint64(32)


def _kept(char: str) -> bool:
    return unicodedata.category(char)[0] in "LMN"


@cache
def _table() -> np.ndarray:
    """Which of the code points below 2^16 are kept."""
    return np.array([_kept(chr(c)) for c in range(1 << 16)])


def _points(part: str) -> np.ndarray:
    """Code points of a part of a text, lower-cased, with a blank for every other character."""
    points = np.frombuffer(part.lower().encode("utf-32-le", "replace"), np.uint32)
    kept = _table()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        which, place = np.unique(points[high], return_inverse=True)
        kept[high] = np.array([_kept(chr(c)) for c in which])[place]
    return np.where(kept, points, 32).astype(np.uint64)


def _strides(text: str) -> Iterator[str]:
    """Parts of a text, cut behind a blank where there is one."""
    at = 0
    while at < len(text):
        end = at + STRIDE
        if end < len(text):
            end = max(text.rfind(" ", at, end) + 1, 0) or end
        yield text[at:end]
        at = end


def ngrams(text: str) -> Iterator[list[np.ndarray]]:
    """Codes of all n-grams of a text, an array per order for each stride.  Words are
    told apart by one blank; the text begins and ends with one."""
    parts = list(_strides(text))
    held = np.array([_BLANK])                                # the end of what came before
    for i, part in enumerate(parts):
        points = np.concatenate([held, _points(part), [_BLANK] if i == len(parts) - 1 else held[:0]])
        blank = points == _BLANK
        points = points[~np.append(False, blank[1:] & blank[:-1])]
        code, out = np.zeros(len(points), np.uint64), []
        for n in range(1, max(ORDERS) + 1):
            code = code[:max(len(points) - n + 1, 0)] * _FACTOR + points[n - 1:]
            if n in ORDERS:                                  # what lies in ``held`` whole was given out before
                out.append((code[max(len(held) - n + 1, 0):] + np.uint64(n)) * _FACTOR)
        yield out
        held = points[1 - max(ORDERS):]


def _mixed(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Lookup:
    """Positions of n-grams among the sorted ``codes`` of a model; a bitmap
    rejects most others with one read."""

    BITS = 20

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[_mixed(codes, self.BITS)] = True

    def present(self, text: str) -> np.ndarray:
        """Distinct features of a text, ascending."""
        if not len(self.codes):
            return np.empty(0, np.int64)
        found = [np.unique(np.concatenate([c[self.maybe[_mixed(c, self.BITS)]] for c in orders])) for orders in ngrams(text)]
        c = np.unique(np.concatenate([*found, self.codes[:0]])) if len(found) != 1 else found[0]
        at = np.searchsorted(self.codes, c)
        at[at == len(self.codes)] = 0
        return at[self.codes[at] == c]


@dataclass
class Model:
    codes: np.ndarray       # sorted n-gram codes
    weights: np.ndarray     # log-count ratio times the learned weight
    base: float


def _fit_linear(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, scale: np.ndarray, *,
                ridge: float = 1.0, steps: int = 300, memory: int = 10) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on 0/1 features times ``scale``, by
    limited-memory quasi-Newton steps on a bounded sample."""
    idx = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value, n, d = scale[idx], len(rows), len(scale)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(of, value * v[idx], n) + v[d]
        off = weight * (1 / (1 + np.exp(-z)) - y)
        total = (weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (v[:d] ** 2).sum()
        return float(total), np.append(np.bincount(idx, value * off[of], d) + ridge * v[:d], off.sum())

    v = np.zeros(d + 1)
    f, g = loss(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, back = g.copy(), []
        for s, t in reversed(past):
            a = (s @ step) / (s @ t)
            back.append(a)
            step -= a * t
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, t), a in zip(past, reversed(back), strict=True):
            step += (a - (t @ step) / (s @ t)) * s
        size, slope = 1.0, g @ step
        while size > 1e-10:
            new = v - size * step
            f_new, g_new = loss(new)
            if f_new <= f - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, t = new - v, g_new - g
        done = f - f_new < 1e-7 * max(1.0, abs(f))
        v, f, g = new, f_new, g_new
        if s @ t > 1e-12:
            past = [*past, (s, t)][-memory:]
        if done:
            break
    return v[:d], float(v[d])


def _count(sample: DataFrame, text: str) -> DataFrame:
    """Documents of either class that hold each n-gram: code, pos, neg.  A text
    of one stride is one set; the sets of a longer one meet in Spark, under the text's number."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(codes: np.ndarray, pos: np.ndarray, neg: np.ndarray, row: int | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(pos), pa.array(neg),
                                               pa.array([row] * len(codes), pa.int64())], ["code", "pos", "neg", "row"])

        def flush(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
            codes, where = np.unique(np.concatenate([*held[1], *held[0]]), return_inverse=True)
            n1 = sum(map(len, held[1]))
            return rows(codes, *(np.bincount(w, minlength=len(codes)) for w in (where[:n1], where[n1:])), None)

        held, size = {0: [], 1: []}, 0
        for batch in batches:
            for t, y, row in zip(*(batch.column(c).to_pylist() for c in (text, "y", "row")), strict=True):
                for orders in ngrams(t or ""):
                    own = np.unique(np.concatenate(orders))
                    if len(t) > STRIDE:
                        yield rows(own, np.full(len(own), y), np.full(len(own), 1 - y), row)
                    else:
                        held[y].append(own)
                        size += len(own)
                if size > 4_000_000:
                    yield flush(held)
                    held, size = {0: [], 1: []}, 0
        if size:
            yield flush(held)

    each = sample.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "code bigint, pos bigint, neg bigint, row bigint")
    sets = [F.when(F.col("row").isNull(), F.sum(c)).otherwise(F.max(c)).alias(c) for c in ("pos", "neg")]
    return each.groupBy("code", "row").agg(*sets).groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", id_col: str = "doc_id",
        per_class: int = 3000, max_features: int = 20_000, min_docs: int = 5, min_z: float = 3.0,
        smooth: float = 1.0, ridge: float = 1.0) -> Model:
    """Learn from at most ``per_class`` labelled documents of each class, drawn from ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    labels = scratch.put(labels_of(docs, labels.select(id_col, label), id_col), "labels")
    total = dict(labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect())
    picked = bounded_sample(labels, label, per_class, id_col=id_col)
    sample = scratch.put(docs.select(id_col, text).join(F.broadcast(picked), id_col).select(F.col(text).alias("text"), "y"),
                         "sample")
    found = dict(sample.groupBy("y").count().collect())
    n1, n0 = found.get(1, 0), found.get(0, 0)
    counts = _count(sample, "text").filter(F.col("pos") + F.col("neg") >= min_docs)
    p, q = F.col("pos") + smooth, F.col("neg") + smooth
    ratio = F.log(p / (n1 + 2 * smooth)) - F.log(q / (n0 + 2 * smooth))
    z = F.abs(ratio) / F.sqrt(1 / p + 1 / q)
    top = (counts.select("code", ratio.alias("r"), z.alias("z")).filter(F.col("z") >= min_z)
           .orderBy(F.desc("z"), "code").limit(max_features).toPandas())           # bounded by max_features
    codes = top["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    codes, scale = codes[order], top["r"].to_numpy(float)[order]
    shared = spark.sparkContext.broadcast(codes)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(shared.value)
        for batch in batches:
            rows = [look.present(t or "").tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.int32()))], ["y", "f"])

    known = sample.select("y", "text").mapInArrow(features, "y int, f array<int>").toPandas()   # 2 x per_class rows
    scratch.drop("sample", "labels")
    y = known["y"].to_numpy(float)
    if not len(y):
        return Model(codes[:0], scale[:0], 0.0)
    weight = np.where(y == 1, total.get(1, 0) / max(n1, 1), total.get(0, 0) / max(n0, 1))
    weight = weight * len(y) / weight.sum()
    w, b = _fit_linear([np.asarray(f, np.int64) for f in known["f"]], y, weight, scale, ridge=ridge)
    return Model(codes, w * scale, b)


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic (double, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(docs.schema, [(out, "double")])
    kept = [f.name for f in schema.fields[:-1]]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        look = Lookup(m.codes)
        for batch in batches:
            z = np.array([m.weights[look.present(t or "")].sum() + m.base for t in batch.column(text).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(1 / (1 + np.exp(-z)), pa.float64())],
                                             [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
