"""Counting and profiling aggregates (one pass, partial aggregation map-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import RETRAIN_THRESHOLD


def percentile(c, p, accuracy: int | None = None) -> Column:
    """Exact ``percentile`` (linear interpolation, numpy/pandas default).

    Spark keeps a value -> count map per group, so memory grows with the
    number of *distinct* values.  Work-item durations are whole seconds, so
    that is bounded by the duration range, not by the row count.  For
    continuous inputs at scale pass ``accuracy`` to use the bounded-memory
    ``percentile_approx`` sketch instead (rank error 1/accuracy).
    """
    col = F.col(c) if isinstance(c, str) else c
    if accuracy:
        return F.percentile_approx(col, p, accuracy)
    return F.percentile(col, p)


def median(c, accuracy: int | None = None) -> Column:
    return percentile(c, 0.5, accuracy)


def feedback_counts(fb: DataFrame, threshold: int = RETRAIN_THRESHOLD,
                    used="is_used_for_training") -> DataFrame:
    """total, unused, ready = unused >= threshold, remaining = max(0, threshold - unused)."""
    agg = fb.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col(used) == 0).alias("unused"))
    return agg.select("total", "unused",
                      (F.col("unused") >= threshold).alias("retrain_ready"),
                      F.greatest(F.lit(0).cast("bigint"), F.lit(threshold) - F.col("unused")).alias("remaining"))


def feedback_metrics(fb: DataFrame, delta="delta_pct") -> DataFrame:
    """rows, mean signed delta (1 dp) and share with |delta| <= 25 (3 dp).

    Both means are over non-null deltas only and null when there are none.
    """
    d = F.col(delta)
    return fb.agg(
        F.count(F.lit(1)).alias("feedbacks_collected"),
        F.bround(F.avg(d), 1).alias("feedback_mean_delta_pct"),
        F.bround(F.avg(F.when(d.isNotNull(), F.when(F.abs(d) <= 25.0, 1.0).otherwise(0.0))), 3)
         .alias("feedback_accuracy_within_25pct"),
    )


def target_profile(df: DataFrame, target="logged_days") -> DataFrame:
    y = F.col(target)
    return df.agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        median(y).alias("median"),
        F.stddev_samp(y).alias("std"),
        percentile(y, 0.95).alias("p95"),
        percentile(y, 0.99).alias("p99"),
        F.max(y).alias("max"),
    )


def category_profile(df: DataFrame, columns=("region", "subsystem", "commitments")) -> DataFrame:
    """Per categorical column: distinct values, most frequent value and its share.

    The columns are unpivoted so a single aggregation (one shuffle, combined
    map-side) counts every (column, value) pair; ties on the top count go
    to the smallest value.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")).select("p.column", "p.value").filter(F.col("value").isNotNull())
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top_value"),
        (F.max("cnt") / F.sum("cnt")).alias("top_share"),
    )


def row_accounting(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows imported, rows kept after filters and share dropped."""
    b = before.agg(F.count(F.lit(1)).alias("rows_imported"))
    a = after.agg(F.count(F.lit(1)).alias("rows_kept"))
    return b.select("rows_imported", a.scalar().alias("rows_kept")).withColumn(
        "share_dropped", 1.0 - F.col("rows_kept") / F.col("rows_imported"))


def fold_summary(scores: DataFrame, score="score", by=None) -> DataFrame:
    """Mean and population std of fold scores."""
    g = scores.groupBy(*by) if by else scores
    return g.agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
                 F.count(F.lit(1)).alias("n_folds"))


def class_weights(df: DataFrame, label="risk_level") -> DataFrame:
    """Balanced weight per class = largest class count / class count."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("weight", F.max("n_rows").over(Window.partitionBy()) / F.col("n_rows"))


def with_class_weight(df: DataFrame, label="risk_level", out="weight") -> DataFrame:
    """Attach class weights; the weight table has one row per class."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")
