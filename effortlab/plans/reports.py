"""Reports a user runs: naive baselines, error analysis, service metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import hours_saved, short_revision
from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators import topk as K
from ..operators.joins import lookup_with_fallback


def group_medians(train: DataFrame, key: str, target: str = "logged_days") -> DataFrame:
    """Median target per group (null groups excluded), then log1p."""
    return (train.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.log1p(A.median(target)).alias("median_log")))


def baseline_predictions(train: DataFrame, test: DataFrame, target: str = "logged_days",
                         keys=("subsystem", "region")) -> DataFrame:
    """Test rows with constant (global median) and per-group median
    predictions in log space.  The global median is a scalar subquery, so no
    cross join; group medians have one row per group."""
    global_log = train.agg(A.median(F.log1p(F.col(target)))).scalar()
    out = test.withColumn("pred_global", global_log)
    for key in keys:
        out = lookup_with_fallback(out, group_medians(train, key, target), key, "median_log",
                                   F.col("pred_global"), out=f"pred_{key}")
    return out


def baseline_report(train: DataFrame, test: DataFrame, target: str = "logged_days",
                    model_pred_log: str | None = None, decimals: bool = True) -> DataFrame:
    """One row per baseline (and the model if its log prediction column is
    given): R² in log space (as the original report) and in days, MAE in
    days.  All predictors are scored in a single pass over the test set."""
    preds = baseline_predictions(train, test, target)
    named = [("Global median", "pred_global"), ("Median by subsystem", "pred_subsystem"),
             ("Median by region", "pred_region")]
    if model_pred_log:
        named.append(("Model ensemble", model_pred_log))
    y = F.col(target)
    ylog = F.log1p(y)
    exprs = []
    for i, (_, col) in enumerate(named):
        p = F.col(col)
        pdays = F.greatest(F.expm1(p), F.lit(0.0))
        exprs += [M.r2_expr(ylog, p).alias(f"r2_log_{i}"), M.r2_expr(y, pdays).alias(f"r2_days_{i}"),
                  M.mae_expr(y, F.expm1(p)).alias(f"mae_{i}")]
    wide = preds.agg(*exprs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("baseline"), F.col(f"r2_log_{i}").alias("r2_log"),
                 F.col(f"r2_days_{i}").alias("r2_days"), F.col(f"mae_{i}").alias("mae_days"))
        for i, (name, _) in enumerate(named)]))
    out = wide.select(rows.alias("r")).select("r.*")
    if decimals:
        out = out.withColumns({"r2_log": F.bround("r2_log", 4), "r2_days": F.bround("r2_days", 4),
                               "mae_days": F.bround("mae_days", 3)})
    return out


def with_errors(preds: DataFrame, actual: str = "logged_days", pred: str = "pred_days") -> DataFrame:
    return preds.withColumns({"actual_days": F.col(actual), "abs_error_days": F.abs(F.col(actual) - F.col(pred))})


def error_report(preds: DataFrame, top_n: int = 10, decimals: int | None = 2) -> DataFrame:
    """Overall MAE, the N subsystems with the largest MAE, every region and
    the N worst predictions (the group is the ticket, its error stands under mae
    and its actual days under median_actual), as one long table (section, group,
    count, mae, median_actual)."""
    e = with_errors(preds)
    overall = e.agg(F.count("abs_error_days").alias("count"), F.avg("abs_error_days").alias("mae"),
                    A.median("actual_days").alias("median_actual"))
    overall = overall.select(F.lit("overall").alias("section"), F.lit(None).cast("string").alias("group"), "*")
    sub = K.top_n_groups(M.grouped_errors(e, "subsystem", decimals=None), "subsystem", top_n)
    reg = M.grouped_errors(e, "region", decimals=None)
    worst = K.worst_predictions(e, top_n, decimals=None).select(
        F.lit("worst").alias("section"), F.col("ticket_id").cast("string").alias("group"), F.lit(1).cast("long").alias("count"),
        F.col("abs_error_days").alias("mae"), F.col("actual_days").alias("median_actual"))
    parts = [overall,
             sub.select(F.lit("subsystem").alias("section"), F.col("subsystem").alias("group"),
                        "count", "mae", "median_actual"),
             reg.select(F.lit("region").alias("section"), F.col("region").alias("group"),
                        "count", "mae", "median_actual")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(worst)
    if decimals is not None:
        out = out.withColumns({"mae": F.bround("mae", decimals), "median_actual": F.bround("median_actual", decimals)})
    return out


def latest_runs_row(runs: DataFrame):
    """Scalar subqueries over the newest estimate and risk runs."""
    est = runs.filter(F.col("model_type") == "estimate")
    risk = runs.filter(F.col("model_type") == "risk")
    order = F.struct("created_at", "run_id")
    latest_est = est.agg(F.max_by(F.struct("run_id", "created_at", "trigger", "r2", "mae"), order).alias("r"))
    latest_risk = risk.agg(F.max_by("overrun_recall", order).alias("v"))
    return latest_est, latest_risk


def model_status(runs: DataFrame) -> DataFrame:
    """Short revision and publish time of the newest effort model (nulls if none)."""
    est = runs.filter(F.col("model_type") == "estimate")
    r = est.agg(F.max_by(F.struct("run_id", "created_at"), F.struct("created_at", "run_id")).alias("r"))
    return r.select(short_revision(F.col("r.run_id")).alias("model_revision"),
                    F.col("r.created_at").alias("model_published_at"))


def metrics_report(runs: DataFrame, fb: DataFrame) -> DataFrame:
    """One row: newest estimate run (revision, time, trigger, r2, mae), newest
    risk run recall, feedback metrics and hours saved."""
    latest_est, latest_risk = latest_runs_row(runs)
    m = A.feedback_metrics(fb)
    r = F.col("r")
    base = latest_est.select(
        short_revision(r["run_id"]).alias("model_revision"),
        r["created_at"].alias("model_published_at"),
        r["trigger"].alias("model_trigger"),
        r["r2"].alias("model_r2"),
        r["mae"].alias("model_mae"),
        latest_risk.scalar().alias("model_overrun_recall"),
        m.select("feedbacks_collected").scalar().alias("feedbacks_collected"),
        m.select("feedback_mean_delta_pct").scalar().alias("feedback_mean_delta_pct"),
        m.select("feedback_accuracy_within_25pct").scalar().alias("feedback_accuracy_within_25pct"),
    )
    return base.withColumn("estimated_hours_saved_per_sprint", hours_saved(F.col("feedbacks_collected")))
