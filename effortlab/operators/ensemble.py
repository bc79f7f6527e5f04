"""Fold ensembles: effort in log space, class probabilities by mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / float(len(cols))


def ensemble_effort(df: DataFrame, pred_cols: list[str], out: str = "pred_days",
                    spread: str = "pred_std_days", log_out: str = "pred_log") -> DataFrame:
    """Mean of fold predictions in log space (``log_out``) -> expm1 -> clip
    at 0 (``out``); spread is
    the population std of the per-fold predictions in days.  Row-wise: the
    fold columns sit on the same row, so no shuffle."""
    logs = [F.col(c) for c in pred_cols]
    days = [F.expm1(c) for c in logs]
    mean_days = _mean(days)
    var = _mean([(d - mean_days) * (d - mean_days) for d in days])
    return df.withColumns({
        log_out: _mean(logs),
        out: F.greatest(F.expm1(_mean(logs)), F.lit(0.0)),
        spread: F.sqrt(var),
    })


def ensemble_risk(df: DataFrame, prob_cols: list[list[str]], names=("p_low", "p_medium", "p_critical"),
                  out: str = "pred_risk") -> DataFrame:
    """``prob_cols[k][c]`` is fold k's probability of class c.  Mean per class
    over folds; predicted class = argmax, lowest index on ties."""
    n_classes = len(names)
    means = {names[c]: _mean([F.col(fold[c]) for fold in prob_cols]) for c in range(n_classes)}
    df = df.withColumns(means)
    p = [F.col(n) for n in names]
    arg = F.lit(n_classes - 1)
    for c in reversed(range(n_classes - 1)):
        cond = None
        for o in range(c + 1, n_classes):
            ge = p[c] >= p[o]
            cond = ge if cond is None else cond & ge
        for o in range(c):
            gt = p[c] > p[o]
            cond = cond & gt
        arg = F.when(cond, F.lit(c)).otherwise(arg)
    return df.withColumn(out, arg.cast("int"))


def ensemble_risk_arrays(df: DataFrame, prob_arrays: list[str], names=("p_low", "p_medium", "p_critical"),
                         out: str = "pred_risk") -> DataFrame:
    """Same as :func:`ensemble_risk` for ``array<double>`` probability columns
    (e.g. ``vector_to_array(probability)`` of fold models)."""
    n = len(names)
    cols = [[F.col(a)[c] for c in range(n)] for a in prob_arrays]
    means = {names[c]: _mean([fold[c] for fold in cols]) for c in range(n)}
    df = df.withColumns(means)
    arr = F.array(*[F.col(x) for x in names])
    return df.withColumn(out, (F.array_position(arr, F.array_max(arr)) - 1).cast("int"))
