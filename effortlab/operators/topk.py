"""Top-k, latest-per-key and newest-rows operators.

Global top-k uses ``orderBy().limit()`` (TakeOrderedAndProject: each task
keeps k rows).  Per-group top-k uses ``row_number() <= k``, for which Spark
inserts a partial per-partition group limit before the shuffle, so a hot
group never sends more than k rows per task.  Latest-per-key is an
aggregate (``max_by``), combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: str, n: int, tie: str | list[str] | None = None, ascending: bool = False) -> DataFrame:
    ties = [tie] if isinstance(tie, str) else list(tie or [])
    order = [F.col(by).asc() if ascending else F.col(by).desc()] + [F.col(t).asc() for t in ties]
    return df.orderBy(*order).limit(n)


def top_n_groups(df: DataFrame, key: str, n: int, by: str = "mae") -> DataFrame:
    """N worst groups by ``by`` (descending), ties by key."""
    return top_n(df, by, n, key)


def worst_predictions(df: DataFrame, n: int = 10, abs_error: str = "abs_error_days",
                      tie: str = "ticket_id", decimals: int | None = 1,
                      columns=("ticket_id", "summary", "subsystem", "region", "actual_days", "pred_days",
                               "abs_error_days")) -> DataFrame:
    out = top_n(df, abs_error, n, tie).select(*columns)
    if decimals is not None:
        out = out.withColumns({abs_error: F.bround(abs_error, decimals), "pred_days": F.bround("pred_days", decimals)})
    return out


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` tuple per key, as an aggregate
    (``max_by`` over a struct), so a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), ordering).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def upsert_latest(runs: DataFrame, key: str = "run_id", seq: str = "seq") -> DataFrame:
    """Insert-or-replace by key: the last write (highest ``seq``) wins."""
    return latest_per_key(runs, [key], [seq])


def latest_model_run(runs: DataFrame, model_type: str | None = None, by: str = "model_type",
                     order=("created_at", "run_id")) -> DataFrame:
    """Newest run per model type (ties on created_at broken by run_id)."""
    if model_type is not None:
        runs = runs.filter(F.col(by) == model_type)
    return latest_per_key(runs, [by], list(order))


def recent(df: DataFrame, n: int = 5, by: str = "id") -> DataFrame:
    return df.orderBy(F.col(by).desc()).limit(n)


def top_features(contribs: Column, k: int = 10, decimals: int = 4) -> Column:
    """Per row: the k (feature, value) pairs with the largest |value|."""
    def cmp(a, b):
        x, y = F.abs(a["shap_value"]), F.abs(b["shap_value"])
        return F.when(x > y, -1).when(x < y, 1).otherwise(0)
    top = F.slice(F.array_sort(contribs, cmp), 1, k)
    return F.transform(top, lambda e: F.struct(e["feature"].alias("feature"),
                                               F.bround(e["shap_value"], decimals).alias("shap_value")))
