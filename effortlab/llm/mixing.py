"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source x language x topic).  Their tokens per cell
are summed in Spark (combined map-side, so a source with a third of all rows is
no hot key), and the cell weights are raked: scaled to the target shares of one
margin after the other until all margins hold.  A document's probability is its
cell's weight times one scale for all, 1 at most, so no document is taken more than
once.  With ``shortfall`` 0 the scale is one over the largest weight and the expected
token shares are the targets; a larger one lets cells that are too scarce for their
weight be taken whole, as long as not more than that share of the tokens is missing
for it, so that a handful of documents cannot shrink the whole mixture.  Documents
are then drawn by a hash of their id, in place, without a shuffle.

Only the cells reach the driver.  Their number is bounded by the targets: values
that no target names share the entry ``"*"``, so there are at most
(sources + 1) (languages + 1) (topics + 1) cells whatever the data holds.

A margin may be a rule instead of a mapping: with ``Tempered`` every value that the data
holds is a target by its own name, in proportion to its tokens to a power under 1, so
that large values are brought down and small ones up whatever they are called.  Beyond
the ``most`` values with the most tokens (ties: the smallest names) the others share
``"*"``, which gets the sum of what each of them would get, and one weight.  The sums
that this needs stay in Spark; only the named values reach the driver.

Defined results: null values of a margin count under ``"*"``; without an entry
``"*"`` unnamed values keep the share that they have, be it all, and the named ones divide the
rest in proportion.  Shares of values that hold no tokens go to the others in
proportion.  A document without tokens is drawn like its cell.  Null ids are
drawn by a hash of the text.  Repeated rows are drawn alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_value, tidy, trim, with_fields

by_value(__name__)

OTHER = "*"


@dataclass(frozen=True)
class Tempered:
    """Targets in proportion to each value's tokens to a power; at most ``most`` by name."""
    power: float = 0.7
    most: int = 1000


def describe(docs: DataFrame, *, text: str = "text", topics: int = 8) -> DataFrame:
    """``docs`` with ``n_tokens`` (words) and ``topic``: its most frequent word
    of five letters or more (ties: the smallest), dealt to one of ``topics``
    classes ``t0``, ``t1`` ... by crc32; null if there is no such word."""
    schema = with_fields(docs.schema, [("n_tokens", "bigint"), ("topic", "string")])
    kept = [f.name for f in schema.fields[:-2]]

    def of(words: list[str]) -> str | None:
        count = Counter([w for w in words if len(w) >= 5 and w.isalpha()])
        if not count:
            return None
        most = max(count.values())
        return f"t{zlib.crc32(min(w for w, n in count.items() if n == most).encode()) % topics}"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            n, topic = [], []
            for t in batch.column(text).to_pylist():
                words = (t or "").split()
                n.append(len(words))
                topic.append(of(words))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(n, pa.int64()), pa.array(topic, pa.string())],
                                             [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def rake(cells: list[tuple[tuple[str, ...], float]], targets: list[Mapping[str, float]], *, rounds: int = 1000,
         slack: float = 1e-4) -> dict[tuple[str, ...], float]:
    """Weight of each cell such that the weighted sizes of every margin are in
    the proportions of its target; the mean weight per size is 1.  Targets that
    no weights meet (``slack``: as a share of the whole) are an error."""
    weights, off = fit(cells, targets, rounds=rounds)
    if off > slack:
        raise ValueError(f"the targets contradict each other: a margin misses its target by {off:.4f} of the whole")
    return weights


def fit(cells: list[tuple[tuple[str, ...], float]], targets: list[Mapping[str, float]], *, rounds: int = 1000,
        near: float = 1e-9) -> tuple[dict[tuple[str, ...], float], float]:
    """The weights after ``rounds`` rounds at most, and the largest share of
    the whole by which a margin still misses its target (0 but where empty
    cells make the targets contradict each other)."""
    keys = [k for k, _ in cells]
    size = np.array([s for _, s in cells], float)
    total = size.sum()
    margins = []
    for d, target in enumerate(targets):
        names = sorted({k[d] for k in keys})
        place = {n: i for i, n in enumerate(names)}
        code = np.array([place[k[d]] for k in keys], np.int64)
        held = np.bincount(code, size, len(names))
        want = np.array([target.get(n, 0.0) for n in names]) * (held > 0)
        own = np.array([held[i] if n == OTHER and OTHER not in target else 0.0 for i, n in enumerate(names)])
        if want.sum() > 0:
            want = own + want / want.sum() * (total - own.sum())
        elif own.sum() > 0 and not held[own == 0].any():         # all tokens are in unnamed values
            want = own
        else:
            raise ValueError(f"no tokens in any value that has a target: {dict(target)}")
        margins.append((code, want, len(names)))
    w, off = np.ones(len(keys)), 0.0
    for _ in range(rounds):
        off = 0.0
        for code, want, n in margins:
            have = np.bincount(code, size * w, n)
            factor = np.divide(want, have, out=np.where(want > 0, 1.0, 0.0), where=have > 0)
            off = max(off, float(np.abs(have - want).max(initial=0) / max(total, 1e-9)))
            w = w * factor[code]
        if off < near:
            break
    return dict(zip(keys, w.tolist(), strict=True)), off


def scale(sizes: list[float], weights: list[float], shortfall: float = 0.0) -> float:
    """The largest factor on the weights at which the cells whose probability it
    would raise over 1 miss at most ``shortfall`` of the tokens to be drawn."""
    size, w = np.array(sizes, float), np.array(weights, float)
    drawn, best = float((size * w).sum()), 1.0
    for top in np.unique(w[(size > 0) & (w > 0)])[::-1]:
        if (size * np.maximum(w - top, 0)).sum() > shortfall * drawn:
            break
        best = 1 / float(top)
    return best


def _name(column: str, target: Mapping[str, float]) -> Column:
    named = [n for n in target if n != OTHER]
    c = F.col(column).cast("string")
    return F.when(c.isin(*named), c).otherwise(OTHER) if named else F.lit(OTHER)


def tempered(sizes: DataFrame, rule: Tempered) -> dict[str, float]:
    """Targets of a margin by a rule; ``sizes`` has value and size.  A null value and one
    called ``"*"`` count as one value under ``"*"``; a value without tokens has no target."""
    sizes = sizes.groupBy("value").agg(F.sum("size").alias("size")).filter("size > 0")
    power = F.pow(F.col("size").cast("double"), F.lit(rule.power))
    named = sizes.filter(F.col("value") != OTHER).orderBy(F.desc("size"), "value").limit(rule.most) \
        .select("value", power.alias("share")).collect()                    # bounded by the rule
    shares = {r["value"]: r["share"] for r in named}
    rest = sizes.filter(~F.col("value").isin(*shares)) if shares else sizes
    shares[OTHER] = rest.agg(F.sum(power)).first()[0] or 0.0
    whole = sum(shares.values())
    return {v: s / whole for v, s in shares.items()} if whole else {OTHER: 1.0}


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | Tempered], *, tokens: str = "n_tokens",
        id_col: str = "doc_id", text: str | None = None, seed: int = 17, shortfall: float = 0.0) -> DataFrame:
    """``docs`` with ``probability`` (double), ``taken`` (boolean) and
    ``margin_off`` (double, one value for all: the largest share of the tokens by
    which a margin misses its target; 0 unless the targets contradict each other).
    ``targets``: column -> value -> share of the tokens, or column -> rule."""
    spark = docs.sparkSession
    rules = {i: c for i, (c, t) in enumerate(targets.items()) if isinstance(t, Tempered)}
    names = [F.coalesce(F.col(c).cast("string"), F.lit(OTHER)) if i in rules else _name(c, t) for i, (c, t) in enumerate(targets.items())]
    sums = docs.groupBy(*[n.alias(f"m{i}") for i, n in enumerate(names)]).agg(F.sum(tokens).alias("size"))
    if rules:                                                # the texts are read once for all sums
        scratch = Scratch(spark, "mixing")
        sums = scratch.put(sums, "sums")
        targets = {c: tempered(sums.select(F.col(f"m{i}").alias("value"), "size"), t) if i in rules else t
                   for i, (c, t) in enumerate(targets.items())}
        sums = sums.groupBy(*[_name(f"m{i}", t).alias(f"m{i}") if i in rules else F.col(f"m{i}")
                              for i, t in enumerate(targets.values())]).agg(F.sum("size").alias("size"))
    found = sums.withColumn("size", F.col("size").cast("double")).collect()                  # bounded by the targets
    if rules:
        scratch.drop("sums")
    cells = [(tuple(r[f"m{i}"] for i in range(len(names))), r["size"] or 0.0) for r in found]
    weights, off = fit(cells, list(targets.values())) if sum(s for _, s in cells) else ({k: 1.0 for k, _ in cells}, 0.0)
    factor = scale([s for _, s in cells], [weights[k] for k, _ in cells], shortfall)
    rows = [(*k, min(1.0, w * factor)) for k, w in weights.items()]
    schema = ", ".join(f"`__m{i}` string" for i in range(len(names))) + ", `probability` double"
    drawn = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text) if text else F.lit("")))
    share = F.shiftrightunsigned(drawn, 11).cast("double") / float(1 << 53)
    keyed = docs.drop("probability", "taken", "margin_off").withColumns({f"__m{i}": _name(c, t) for i, (c, t) in enumerate(targets.items())})
    return (keyed.join(F.broadcast(spark.createDataFrame(rows, schema)), [f"__m{i}" for i in range(len(names))])
            .withColumns({"taken": share < F.col("probability"), "margin_off": F.lit(float(off))})
            .drop(*[f"__m{i}" for i in range(len(names))]))
