"""Exact quantiles of any column, at any size, without a one-task value map.

Spark's ``percentile`` merges a value -> count map in one task.  Here equal
values are counted first (combined map-side, so a frequent value is no hot
key), the counts are range-partitioned by value, and the totals of the
partitions say where the wanted ranks lie.  One such table serves many sets of
rows at once: it holds a count for each set.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def quantiles_of_counts(counts: DataFrame, sets: list[str], shares: list[float]) -> DataFrame:
    """One row with a column ``<set>_<i>`` for the i-th share of every set:
    the quantile with linear interpolation, as ``percentile`` has it (null for
    an empty set).  ``counts`` has a value ``v``, each once, and for every set
    how often it holds the value.  Infinite values and NaN take part, ordered as
    Spark orders them (NaN last)."""
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # The partition id is data from here on, so it is written with the counts.
    held = materialize(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "quantiles")
    totals = held.groupBy("part").agg(*[F.sum(s).alias(s) for s in sets])           # one row per partition
    totals = totals.select("part", *[(F.sum(s).over(Window.orderBy("part")) - F.col(s)).alias(f"{s}_before") for s in sets],
                           *[F.sum(s).over(Window.partitionBy()).alias(f"{s}_total") for s in sets])
    within = Window.partitionBy("part").orderBy("v")
    placed = held.join(F.broadcast(totals), "part").withColumns(
        {f"{s}_last": F.col(f"{s}_before") + F.sum(s).over(within) for s in sets})

    def at(s: str, rank: Column) -> Column:
        last = F.col(f"{s}_last")
        return F.max(F.when((last - F.col(s) <= rank) & (rank < last), F.col("v")))

    found, out = [], []
    for s in sets:
        for i, share in enumerate(shares):
            place = F.lit(float(share)) * (F.col(f"{s}_total") - 1)
            found += [at(s, F.floor(place)).alias(f"{s}_{i}_a"), at(s, F.ceil(place)).alias(f"{s}_{i}_b"),
                      F.max(F.ceil(place) - place).alias(f"{s}_{i}_w")]
            a, b, w = (F.col(f"{s}_{i}_{x}") for x in "abw")
            out.append(F.when(a == b, a).otherwise(w * a + (1 - w) * b).alias(f"{s}_{i}"))
    return placed.agg(*found).select(*out)


def exact_median(df: DataFrame, value: Column, out: str = "median") -> DataFrame:
    """One row: the median of the non-null values (mean of the two middle ones
    for an even count; null if there are none)."""
    counts = df.select(value.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(
        F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(counts, ["n"], [0.5]).select(F.col("n_0").alias(out))


def leave_one_out_quantiles(df: DataFrame, value: str, fold: str, k: int, shares: list[float]) -> DataFrame:
    """(fold, q): for every fold the quantiles (array) of the values of all
    *other* folds.  Rows without fold or value do not count; folds whose others are
    empty have no row."""
    known = df.select(F.col(value).cast("double").alias("v"), F.col(fold).alias("f")).filter("v is not null and f is not null")
    counts = known.groupBy("v").agg(*[F.count_if(F.col("f") != i).alias(f"s{i}") for i in range(k)])
    wide = quantiles_of_counts(counts, [f"s{i}" for i in range(k)], shares)
    rows = F.array(*[F.struct(F.lit(i).alias("fold"), F.array(*[F.col(f"s{i}_{j}") for j in range(len(shares))]).alias("q"))
                     for i in range(k)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").filter(F.col("q")[0].isNotNull())
