"""Targets, labels and scalar business formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Business constants.
WORKDAY_HOURS = 8
SECONDS_PER_WORKDAY = WORKDAY_HOURS * 60 * 60    # 28800
RETRAIN_THRESHOLD = 50
MEDIUM_RISK_BUFFER = 0.15
CRITICAL_RISK_BUFFER = 0.50
HIGH_RISK_PCT = 20.0
MINUTES_SAVED_PER_FEEDBACK = 15
UNKNOWN = "Unknown"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_workdays(seconds="time_spent", hours: int = WORKDAY_HOURS) -> Column:
    return _c(seconds).cast("double") / F.lit(float(hours * 3600))


def filter_valid(df: DataFrame, target="logged_days", estimate="estimate",
                 max_estimate: float = 10.0) -> DataFrame:
    """Keep rows with a target and 0 < estimate <= max_estimate.

    Written on the raw columns, so that it runs before anything computed from
    texts and, for plain columns, in the Parquet scan.
    """
    return df.filter(_c(target).isNotNull() & _c(estimate).isNotNull()
                     & (_c(estimate) > 0) & (_c(estimate) <= max_estimate))


def risk_level(logged="logged_days", estimate="estimate") -> Column:
    """0: ratio <= 1, 1: (1, 1.5], 2: > 1.5, else (no ratio) 0.  ``try_divide``
    keeps a zero estimate from failing under ANSI mode."""
    ratio = F.try_divide(_c(logged), _c(estimate))
    return (F.when(ratio <= 1.0, 0).when(ratio <= 1.5, 1).when(ratio > 1.5, 2)
            .otherwise(0).cast("int"))


def to_log(c) -> Column:
    return F.log1p(_c(c))


def from_log(c) -> Column:
    """expm1, clipped at 0 (days can not be negative)."""
    return F.greatest(F.expm1(_c(c)), F.lit(0.0))


def delta_pct(predicted="predicted_days", actual="actual_days") -> Column:
    """Signed ``(actual - predicted) / actual * 100``; null when actual is 0."""
    a, p = _c(actual), _c(predicted)
    return F.when(a != 0, (a - p) / a * 100.0)


def delta_pct_abs(predicted="predicted_days", actual="actual_days") -> Column:
    """Seeding variant: ``|p - a| / max(a, 0.001) * 100`` to 2 dp (half-even)."""
    a, p = _c(actual), _c(predicted)
    return F.bround(F.abs(p - a) / F.greatest(a, F.lit(0.001)) * 100.0, 2)


def default_category(c, empty_is_missing: bool = True) -> Column:
    col = _c(c)
    if empty_is_missing:
        col = F.nullif(col, F.lit(""))
    return F.coalesce(col, F.lit(UNKNOWN))


def is_blank(c="summary") -> Column:
    from .text import strip_ws
    return F.coalesce(F.length(strip_ws(_c(c))) == 0, F.lit(True))


def split_valid(df: DataFrame, summary="summary") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows whose summary is blank after strip are rejected."""
    blank = is_blank(summary)
    return df.filter(~blank), df.filter(blank)


def risk_buffer_factor(p_medium="p_medium", p_critical="p_critical") -> Column:
    return 1.0 + MEDIUM_RISK_BUFFER * _c(p_medium) + CRITICAL_RISK_BUFFER * _c(p_critical)


def predicted_hours(days="pred_days") -> Column:
    return F.greatest(F.lit(0.0), _c(days) * float(WORKDAY_HOURS))


def adjusted_hours(days="pred_days", p_medium="p_medium", p_critical="p_critical") -> Column:
    return predicted_hours(days) * risk_buffer_factor(p_medium, p_critical)


def format_prediction(days="pred_days", spread="pred_std_days", p_low="p_low",
                      p_medium="p_medium", p_critical="p_critical") -> dict[str, Column]:
    """Response columns: hours 1 dp, spread 2 dp, probabilities in % 1 dp.

    Rounding is half-even (``bround``), as Python's ``round`` on these values.
    """
    return {
        "predicted_time_hours": F.bround(predicted_hours(days), 1),
        "adjusted_time_with_buffer_hours": F.bround(adjusted_hours(days, p_medium, p_critical), 1),
        "prediction_std_days": F.bround(_c(spread), 2),
        "risk_profile": F.struct(
            F.bround(_c(p_low) * 100.0, 1).alias("low_risk_prob_pct"),
            F.bround(_c(p_medium) * 100.0, 1).alias("medium_risk_prob_pct"),
            F.bround(_c(p_critical) * 100.0, 1).alias("critical_risk_prob_pct"),
        ),
    }


def high_risk_flag(critical_pct="critical_risk_prob_pct", threshold: float = HIGH_RISK_PCT) -> Column:
    return (_c(critical_pct) >= threshold).cast("int")


def hours_to_days(hours="predicted_time_hours") -> Column:
    return _c(hours) / float(WORKDAY_HOURS)


def fold_scores_to_json(c="fold_scores") -> Column:
    return F.to_json(F.coalesce(_c(c), F.array().cast("array<double>")))


def fold_scores_from_json(c="fold_scores_json") -> Column:
    """JSON text -> array<double>; null or '' -> []."""
    parsed = F.from_json(F.nullif(_c(c), F.lit("")), "array<double>")
    return F.coalesce(parsed, F.array().cast("array<double>"))


def short_revision(c="run_id", n: int = 7) -> Column:
    return F.substring(_c(c), 1, n)


def hours_saved(n_feedback) -> Column:
    return F.bround(_c(n_feedback) * (MINUTES_SAVED_PER_FEEDBACK / 60.0), 1)


NUMERIC_FEATURES = [
    "has_description", "has_code_block", "is_dev_task", "is_test_task",
    "is_analysis_task", "text_len", "word_count",
]
CATEGORICAL_FEATURES = ["region", "subsystem", "commitments"]


def cast_features(df: DataFrame, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES) -> DataFrame:
    """Numerics -> float32, categoricals -> string (model input types)."""
    cols = {c: F.col(c).cast("float") for c in numeric}
    cols.update({c: F.col(c).cast("string") for c in categorical})
    return df.withColumns(cols)
