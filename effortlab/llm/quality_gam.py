"""Quality classifier: a generalised additive model with pairwise
interactions, learned by cyclic boosting of shallow trees.

Every text statistic gets a lookup table over its bins, and the strongest
pairs of statistics get a table over a coarse grid.  Boosting goes round the
statistics with a small learning rate; each turn fits one shallow tree on the
current gradient and adds its leaves to the table, so the model stays a sum of
tables and a score is a few vectorised additions.

The texts are measured where they are scanned and never shuffled.  Labels are
learned from a bounded sample (``per_class`` rows of each label, the ones with
the smallest id hashes), weighted back to the label counts of all rows.

Defined results: a null or empty text has all statistics at zero and is scored
by the same tables.  Rows without a label, with a null one or with both labels
teach nothing; without any usable label every score is 0.5.  Other columns pass
through, columns named like a result are replaced, and repeated rows are scored
each.  Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, by_value, labels_of, tidy, with_fields

by_value(__name__)

STATISTICS = ("log_chars", "log_words", "word_length", "word_spread", "longest_word", "short_words", "letters",
              "capitals", "digits", "points", "symbols", "bars", "blanks", "entropy", "distinct_words", "top_word",
              "same_as_last", "log_lines", "line_length", "repeated_lines", "bare_words", "sentence_words")

_KIND = np.zeros(256, np.int64)                     # 0 letter, 1 capital, 2 digit, 3 point, 4 symbol, 5 bar, 6 blank
_KIND[[b for b in range(128) if not chr(b).isalnum()]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"-()"]] = 3
_KIND[ord("|")] = 5
_KIND[[b for b in range(128) if chr(b).isspace()]] = 6
_KIND[[b for b in range(128) if chr(b).isdigit()]] = 2
_KIND[[b for b in range(128) if chr(b).isupper()]] = 1


def statistics(text: str) -> list[float]:
    """The values of STATISTICS for one text."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=seen, minlength=7) / len(raw)
    share = seen[seen > 0] / len(raw)
    entropy = float(-(share * np.log2(share)).sum())
    words = text.split()
    n = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    count = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    repeated = len(lines) - len(set(lines))
    bare = sum(map(str.isalpha, words))
    return [np.log1p(len(text)), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
            (sizes <= 3).mean(), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], entropy,
            len(count) / n, max(count.values(), default=0) / n, same / n, np.log1p(len(lines)),
            np.log1p(len(text) / max(len(lines), 1)), repeated / max(len(lines), 1), bare / n,
            np.log1p(n / (1 + text.count(".")))]


def measure(docs: DataFrame, *, text: str = "text", out: str = "statistics") -> DataFrame:
    """``docs`` with the statistics of each text as an array<double>."""
    schema = with_fields(docs.schema, [(out, "array<double>")])
    kept = [f.name for f in schema.fields[:-1]]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(values, pa.list_(pa.float64()))],
                                             [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _leaves(g: np.ndarray, h: np.ndarray, ridge: float, n_leaves: int) -> np.ndarray:
    """Newton steps of a tree with up to ``n_leaves`` leaves over ordered bins
    with gradient sums ``g`` and curvature sums ``h``."""
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + ridge)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, 0
        gl, hl = g[a:b].cumsum(), h[a:b].cumsum()
        gain = gl[:-1] ** 2 / (hl[:-1] + ridge) + (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + ridge)
        i = int(gain.argmax())
        return float(gain[i] - gl[-1] ** 2 / (hl[-1] + ridge)), a + i + 1

    cuts, parts = [0, len(g)], [(best(0, len(g)), 0, len(g))]
    while len(cuts) <= n_leaves:
        (gain, at), a, b = max(parts)
        if gain <= 1e-9:
            break
        parts.remove(((gain, at), a, b))
        parts += [(best(a, at), a, at), (best(at, b), at, b)]
        cuts = sorted([*cuts, at])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = value(a, b)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of the best tree that cuts both sides of a grid once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        ll, l_, _l, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [ll, l_ - ll, _l - ll, all_ - l_ - _l + ll]

    pg, ph = parts(cg), parts(ch)
    gain = sum(a ** 2 / (b + ridge) for a, b in zip(pg, ph, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    steps = [a[i, j] / (b[i, j] + ridge) for a, b in zip(pg, ph, strict=True)]
    out = np.empty(g.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = steps
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


@dataclass
class Gam:
    """Lookup tables; everything a task needs to score, a few kB."""

    edges: list[np.ndarray]
    grids: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, t in self.pairs:
            out += t[np.searchsorted(self.grids[a], x[:, a], side="right"),
                     np.searchsorted(self.grids[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, bins: int = 64, grid: int = 12, rounds: int = 120,
          pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1, leaves: int = 3, ridge: float = 5.0) -> Gam:
    """Fit the tables by cyclic boosting; first each statistic by itself, then
    the ``n_pairs`` pairs that explain most of what is left."""
    cut = lambda k: [np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) for c in x.T] if len(x) else [
        np.empty(0) for _ in STATISTICS]
    model = Gam(cut(bins), cut(grid))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(x) == 0:
        return model
    rate_1 = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    model.base = float(np.log(rate_1 / (1 - rate_1)))
    at = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    z = np.full(len(x), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slope()
            step = rate * _leaves(np.bincount(at[j], g, len(t)), np.bincount(at[j], h, len(t)), ridge, leaves)
            t += step
            z += step[at[j]]
    cell = [np.searchsorted(e, c, side="right") for e, c in zip(model.grids, x.T, strict=True)]

    def on_grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        na, nb = len(model.grids[a]) + 1, len(model.grids[b]) + 1
        return np.bincount(cell[a] * nb + cell[b], v, na * nb).reshape(na, nb)

    g, h = slope()
    usable = [j for j, e in enumerate(model.grids) if len(e)]
    ranked = sorted(((_quadrants(on_grid(a, b, g), on_grid(a, b, h), ridge)[0], a, b)
                     for a, b in combinations(usable, 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.grids[a]) + 1, len(model.grids[b]) + 1)))
                   for _, a, b in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, t in model.pairs:
            g, h = slope()
            step = rate * _quadrants(on_grid(a, b, g), on_grid(a, b, h), ridge)[1]
            t += step
            z += step[cell[a], cell[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", id_col: str = "doc_id",
        per_class: int = 6000, **settings) -> Gam:
    """Learn from at most ``per_class`` labelled documents of each class, drawn from ``docs``.  Only
    this bounded sample's statistics reach the driver."""
    scratch = Scratch(docs.sparkSession, "quality")
    labels = scratch.put(labels_of(docs, labels.select(id_col, label), id_col), "labels")
    sample = bounded_sample(labels, label, per_class, id_col=id_col)
    total = dict(labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect())
    rows = measure(docs.select(id_col, text).join(F.broadcast(sample), id_col), text=text) \
        .select("statistics", "y").toPandas()
    scratch.drop("labels")
    x = np.array(rows["statistics"].tolist(), float).reshape(-1, len(STATISTICS))
    y = rows["y"].to_numpy(float)
    found = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    scale = len(y) / max(sum(total.get(c, 0) for c in (0, 1)), 1)
    weight = np.where(y == 1, total.get(1, 0) / found[1], total.get(0, 0) / found[0]) * scale
    return learn(x, y, weight, **settings)


def score(docs: DataFrame, model: Gam, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 (double, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(docs.schema, [(out, "double")])
    kept = [f.name for f in schema.fields[:-1]]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(text).to_pylist()], float)
            scores = shared.value.score(x.reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(scores, pa.float64())],
                                             [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
