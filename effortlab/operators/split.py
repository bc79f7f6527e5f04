"""Reproducible splits and cross-validation folds with exact ranks.

A plain ``row_number()`` over a stratum (or ``ntile`` over everything)
sends whole strata to single tasks.  Instead rows are ordered by a salted
md5 of their id; the first hex digits form buckets, a tiny table of
per-(stratum, bucket) counts gives each bucket its rank offset, and the
exact rank is offset + row number inside the bucket.  Work per task is
bounded by the bucket size, whatever the strata sizes, and the ranks equal
the plain window's.  With 5 hex digits (16^5 buckets per stratum) a bucket
holds ~n / 10^6 rows; the count table only has non-empty buckets, so small
inputs pay nothing for the fine grid.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .quantiles import leave_one_out_quantiles


def salted_hash(id_col: str, salt: str):
    return F.md5(F.concat(F.lit(salt), F.col(id_col).cast("string")))


def exact_rank(df: DataFrame, id_col: str, salt: str, partition_cols=(), bucket_digits: int = 5,
               rank_col: str = "_rk", size_col: str = "_n") -> DataFrame:
    """(id, strata, rank, size): 1-based rank by (salted md5, id) within
    ``partition_cols`` and the size of the group.

    Only ids and strata are read and written (once); the input's other columns
    do not take part.  A null stratum is a stratum like any other.  A null id
    has no place in a reproducible order and stops the job.  Rows that repeat
    an id within a stratum share one rank.
    """
    parts = list(partition_cols)
    known = F.coalesce(F.col(id_col), F.raise_error(F.lit(f"{id_col} is null: rows without an id cannot be ranked")))
    keys = materialize(df.select(known.alias(id_col), *parts).distinct(), "rank-keys")
    d = keys.withColumn("_h", salted_hash(id_col, salt)).withColumn("_b", F.substring("_h", 1, bucket_digits))
    counts = d.groupBy(*parts, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wp = Window.partitionBy(*parts) if parts else Window.partitionBy()     # at most 16^digits rows a stratum
    counts = (counts
              .withColumn("_off", F.sum("_nb").over(wp.orderBy("_b")) - F.col("_nb"))
              .withColumn(size_col, F.sum("_nb").over(wp))
              .drop("_nb"))
    # Joined on (stratum, bucket): the keys are shuffled once on those columns
    # and the row_number window below reuses that partitioning.
    w = Window.partitionBy(*parts, "_b").orderBy("_h", id_col)
    d = _join_keys(d, counts, [*parts, "_b"])
    return d.withColumn(rank_col, F.row_number().over(w) + F.col("_off")).drop("_h", "_b", "_off")


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null (null equals null)."""
    named = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    return left.join(named, on).drop(*[f"_r{i}" for i in range(len(keys))])


def split_labels(df: DataFrame, id_col: str = "ticket_id", stratum: str = "risk_level",
                 seed: int = 42, train: float = 0.8, test: float = 0.1, bucket_digits: int = 5) -> DataFrame:
    """(id, stratum, split): the first ``train`` share of each stratum (by hash
    rank) is train, the next ``test`` share test, the rest val."""
    ft = Fraction(train).limit_denominator(1000)
    fte = Fraction(train + test).limit_denominator(1000)
    r = exact_rank(df, id_col, f"{seed}|", [stratum], bucket_digits)
    rk, n = F.col("_rk"), F.col("_n")
    split = (F.when(rk * ft.denominator <= n * ft.numerator, "train")
             .when(rk * fte.denominator <= n * fte.numerator, "test")
             .otherwise("val"))
    return r.withColumn("split", split).drop("_rk", "_n")


def stratified_split(df: DataFrame, id_col: str = "ticket_id", stratum: str = "risk_level", **settings) -> DataFrame:
    """``df`` with ``split`` in {'train', 'test', 'val'} (see
    :func:`split_labels`).  Disjoint, complete and share-preserving per
    stratum; the labels are joined on the id."""
    return _join_keys(df, split_labels(df, id_col, stratum, **settings), [id_col, stratum])


def kfold_labels(df: DataFrame, id_col: str = "ticket_id", k: int = 5, seed: int = 42,
                 bucket_digits: int = 5, out: str = "fold") -> DataFrame:
    """(id, fold): shuffled (not stratified) folds 0..k-1 with ``ntile(k)``
    sizes: the first n mod k folds get one extra row."""
    r = exact_rank(df, id_col, f"fold|{seed}|", [], bucket_digits)
    rk, n = F.col("_rk"), F.col("_n")
    q, rem = F.floor(n / k), n % k
    big = rem * (q + 1)
    fold = F.when(rk <= big, F.floor((rk - 1) / (q + 1))).otherwise(rem + F.floor((rk - 1 - big) / q))
    return r.withColumn(out, fold.cast("int")).drop("_rk", "_n")


def kfold_assign(df: DataFrame, id_col: str = "ticket_id", k: int = 5, seed: int = 42,
                 bucket_digits: int = 5, out: str = "fold") -> DataFrame:
    """``df`` with its fold (see :func:`kfold_labels`), joined on the id."""
    return _join_keys(df, kfold_labels(df, id_col, k, seed, bucket_digits, out), [id_col])


def union_cv(train: DataFrame, val: DataFrame) -> DataFrame:
    return train.unionByName(val)


def fold_bounds(df: DataFrame, k: int = 5, target: str = "logged_days", fold: str = "fold",
                lower: float = 0.01, upper: float = 0.99, accuracy: int | None = None) -> DataFrame:
    """p1/p99 of the target over the training part (fold != k) of every fold.

    Exact, from one table of counted values with a count for every training
    part; with ``accuracy`` approximate, in one aggregate."""
    if accuracy:
        folds = F.array(*[F.lit(i) for i in range(k)])
        ex = df.select(F.explode(F.filter(folds, lambda x: x != F.col(fold))).alias(fold), F.col(target))
        b = ex.groupBy(fold).agg(F.percentile_approx(target, [lower, upper], accuracy).alias("q"))
    else:
        b = leave_one_out_quantiles(df, target, fold, k, [lower, upper]).withColumnRenamed("fold", fold)
    return b.select(fold, F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def fold_roles(df: DataFrame, k: int = 5, target: str = "logged_days", fold: str = "fold",
               bounds: DataFrame | None = None) -> DataFrame:
    """Long table (cv_fold, role, row...) of every fold's training rows
    (trimmed to the bounds, inclusive) and validation rows (untrimmed)."""
    bounds = bounds if bounds is not None else fold_bounds(df, k, target, fold)
    folds = F.array(*[F.lit(i) for i in range(k)])
    ex = df.withColumn("cv_fold", F.explode(folds))
    ex = ex.withColumn("role", F.when(F.col("cv_fold") == F.col(fold), "val").otherwise("train"))
    b = F.broadcast(bounds.withColumnRenamed(fold, "cv_fold"))     # k rows
    ex = ex.join(b, "cv_fold")
    keep = (F.col("role") == "val") | ((F.col(target) >= F.col("lower")) & (F.col(target) <= F.col("upper")))
    return ex.filter(keep).drop("lower", "upper")
