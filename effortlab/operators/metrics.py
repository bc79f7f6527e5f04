"""Regression and classification metrics as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import median
from .quantiles import exact_median


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r2_expr(y, p) -> Column:
    """1 - SSE / SST with SST = n * var_pop(y): one pass, no mean join."""
    y, p = _c(y), _c(p)
    return 1.0 - F.try_divide(F.sum((y - p) * (y - p)), F.count(y) * F.var_pop(y))


def mae_expr(y, p) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)))


def rmse_expr(y, p) -> Column:
    d = _c(y) - _c(p)
    return F.sqrt(F.avg(d * d))


def r2(df: DataFrame, y="y", p="p") -> DataFrame:
    return df.agg(r2_expr(y, p).alias("r2"))


def mae(df: DataFrame, y="y", p="p") -> DataFrame:
    return df.agg(mae_expr(y, p).alias("mae"))


def rmse(df: DataFrame, y="y", p="p") -> DataFrame:
    return df.agg(rmse_expr(y, p).alias("rmse"))


def global_median(df: DataFrame, expr: Column, accuracy: int | None = None) -> Column:
    """Median of an expression over all of ``df``, as a column of an aggregate:
    exact (see ``quantiles``), or a bounded sketch with ``accuracy``."""
    return F.percentile_approx(expr, 0.5, accuracy) if accuracy else exact_median(df, expr).scalar()


def error_distribution_exprs(df: DataFrame, y, p, accuracy: int | None = None) -> list[Column]:
    err = _c(p) - _c(y)
    ae = F.abs(err)
    return [
        F.stddev_pop(err).alias("error_std"),
        global_median(df, ae, accuracy).alias("median_abs_error"),
        F.max(ae).alias("max_abs_error"),
        F.avg((ae <= 0.25).cast("double")).alias("share_within_0_25"),
        F.avg((ae <= 0.5).cast("double")).alias("share_within_0_5"),
        F.avg((ae <= 1.0).cast("double")).alias("share_within_1"),
        F.avg((ae > 2.0).cast("double")).alias("share_over_2"),
    ]


def error_distribution(df: DataFrame, y="y", p="p", accuracy: int | None = None) -> DataFrame:
    return df.agg(*error_distribution_exprs(df, y, p, accuracy))


def mdape(df: DataFrame, y="y", p="p", accuracy: int | None = None) -> DataFrame:
    """Median absolute percentage error (%) over rows with y != 0."""
    ape = F.when(_c(y) != 0, F.abs(_c(y) - _c(p)) / F.abs(_c(y)) * 100.0)
    return df.agg(global_median(df, ape, accuracy).alias("mdape"))


def evaluate_effort(df: DataFrame, y="y", p="p", accuracy: int | None = None) -> DataFrame:
    """r2, mae, rmse and error shares in one aggregate."""
    return df.agg(r2_expr(y, p).alias("r2"), mae_expr(y, p).alias("mae"),
                  rmse_expr(y, p).alias("rmse"), F.count(F.lit(1)).alias("n"),
                  *error_distribution_exprs(df, y, p, accuracy))


def grouped_errors(df: DataFrame, key: str, actual="actual_days", abs_error="abs_error_days",
                   decimals: int | None = 2) -> DataFrame:
    """Per group: count, MAE and median actual.  Null groups are dropped."""
    g = (df.filter(F.col(key).isNotNull()).groupBy(key)
         .agg(F.count(_c(abs_error)).alias("count"), F.avg(abs_error).alias("mae"),
              median(actual).alias("median_actual")))
    if decimals is not None:
        g = g.withColumns({"mae": F.bround("mae", decimals),
                           "median_actual": F.bround("median_actual", decimals)})
    return g


CLASS_NAMES = ["low", "medium", "critical"]


def confusion(df: DataFrame, y="y", p="p") -> DataFrame:
    """(y, p, n) counts; at most n_classes^2 rows."""
    return df.groupBy(_c(y).alias("y"), _c(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, y="y", p="p", n_classes: int = 3) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted
    averages (one row each); zero denominators give 0.

    Everything is computed from the confusion counts, a table of at most
    n_classes^2 rows, with conditional sums in one aggregate.
    """
    cm = confusion(df, y, p)
    exprs = [F.sum("n").alias("total"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("correct")]
    for k in range(n_classes):
        exprs += [
            F.sum(F.when((F.col("y") == k) & (F.col("p") == k), F.col("n")).otherwise(0)).alias(f"tp{k}"),
            F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)).alias(f"sup{k}"),
            F.sum(F.when(F.col("p") == k, F.col("n")).otherwise(0)).alias(f"pred{k}"),
        ]
    wide = cm.agg(*exprs)

    def safe(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    rows = []
    for k in range(n_classes):
        tp, sup, pred = F.col(f"tp{k}"), F.col(f"sup{k}"), F.col(f"pred{k}")
        prec, rec = safe(tp, pred), safe(tp, sup)
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(str(k)).alias("label"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), sup.cast("double").alias("support")))
    per_class = wide.select(F.col("total"), F.col("correct"), F.array(*rows).alias("cls"))
    avg = lambda f: sum(F.col("cls")[k][f] for k in range(n_classes)) / n_classes
    wavg = lambda f: sum(F.col("cls")[k][f] * F.col("cls")[k]["support"]
                         for k in range(n_classes)) / F.col("total")
    acc = safe(F.coalesce(F.col("correct"), F.lit(0)).cast("double"), F.col("total").cast("double"))
    extra = [
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1"), F.col("total").cast("double").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), avg("precision").alias("precision"),
                 avg("recall").alias("recall"), avg("f1").alias("f1"),
                 F.col("total").cast("double").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), wavg("precision").alias("precision"),
                 wavg("recall").alias("recall"), wavg("f1").alias("f1"),
                 F.col("total").cast("double").alias("support")),
    ]
    out = per_class.select(F.explode(F.concat(F.col("cls"), F.array(*extra))).alias("r"))
    return out.select("r.label", "r.precision", "r.recall", "r.f1", "r.support")


def critical_recall(report: DataFrame, critical: int = 2) -> Column:
    return report.filter(F.col("label") == str(critical)).select("recall").scalar()


def evaluate_risk(df: DataFrame, y="y", p="p", n_classes: int = 3) -> DataFrame:
    """Report rows plus the critical-class recall as a column."""
    rep = classification_report(df, y, p, n_classes)
    return rep.withColumn("critical_recall", critical_recall(rep, n_classes - 1))
