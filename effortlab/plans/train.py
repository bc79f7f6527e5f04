"""Offline pipeline: dataset -> split -> TF-IDF/LSA -> features -> fold ensembles."""

from __future__ import annotations

import dataclasses
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as MD
from ..operators import split as SP
from ..operators import text as TX
from ..session import materialize
from ..sources import store as ST


@dataclass
class Trained:
    bundle: MD.Bundle
    splits: DataFrame        # dataset + split (materialised)
    features: DataFrame      # model inputs + split + fold for CV rows (materialised)


@dataclass
class RunStore:
    """Where training leaves its models, run records and metrics."""
    models: str
    runs: str
    metrics: str


def fit_text(splits: DataFrame, k: int = 32, doc: str = "ticket_id", min_df: int = 2,
             max_features: int = 25_000, text: str = "text"):
    """TF-IDF fitted on the training rows (one tokenisation pass), then LSA
    fitted on their weights."""
    train = splits.filter(F.col("split") == "train")
    tfidf, weights = TX.fit_transform_rows(train, F.lit(True), doc, text, min_df, max_features)
    return tfidf, TX.fit_lsa(weights, tfidf.size, k, doc)


def train_all(dataset: DataFrame, k: int = 32, folds: int = 5, with_risk: bool = True,
              effort_params: MD.EffortParams | None = None, risk_params: MD.RiskParams | None = None,
              run_id: str | None = None, store: RunStore | None = None) -> Trained:
    """Split once and cut lineage there and after featurisation (both are
    read by every fold).  With ``store`` the bundle is saved, its parameters
    and metrics logged and its runs recorded."""
    splits = materialize(SP.stratified_split(dataset), "splits")
    # Serving strips the text; train on the same text (no train/serve skew).
    from ..functions import text as T
    splits = splits.withColumn("text", T.concat_text("summary", "description", strip=True))
    tfidf, lsa = fit_text(splits, k)
    cv_rows = splits.filter(F.col("split").isin("train", "val"))
    indexer = MD.category_indexer(cv_rows)
    feats = MD.featurize(splits, tfidf, lsa, indexer)
    folds_of = SP.kfold_labels(cv_rows)                                  # from ids alone
    feats = materialize(feats.join(folds_of, "ticket_id", "left"), "features")
    cv = feats.filter(F.col("fold").isNotNull())
    # Side by side: either leaves cores idle between its small jobs, and neither reads the other's results.
    effort, risk = MD.side_by_side([lambda: MD.train_effort_cv(cv, folds, params=effort_params),
                                    lambda: MD.train_risk_cv(cv, folds, params=risk_params) if with_risk else None])
    bundle = MD.Bundle(tfidf, lsa, indexer, effort, risk, run_id or uuid.uuid4().hex)
    trained = Trained(bundle, splits, feats)
    if store:
        record(trained, store, effort_params or MD.EffortParams(), risk_params or MD.RiskParams())
    return trained


def record(trained: Trained, store: RunStore, effort_params: MD.EffortParams, risk_params: MD.RiskParams,
           trigger: str = "manual") -> None:
    """Save first, then log, then record: a recorded run always has its models."""
    b, spark = trained.bundle, trained.splits.sparkSession
    MD.save_bundle(b, f"{store.models}/{b.run_id}")
    ev = evaluate_bundle(trained)
    eff = {f"test_{m}": ev["effort"][m] for m in ("r2", "mae", "rmse")}
    ST.log_run(spark, store.metrics, b.run_id, dataclasses.asdict(effort_params), eff, b.effort.scores)
    ST.append_run(spark, store.runs, {"run_id": b.run_id, "trigger": trigger, "model_type": "estimate",
                                      **{m: ev["effort"][m] for m in ("r2", "mae", "rmse")}, "fold_scores": b.effort.scores})
    if b.risk is not None:
        risk_id = f"{b.run_id}-risk"
        ST.log_run(spark, store.metrics, risk_id, dataclasses.asdict(risk_params),
                   {"test_overrun_recall": ev["overrun_recall"]}, b.risk.scores)
        ST.append_run(spark, store.runs, {"run_id": risk_id, "trigger": trigger, "model_type": "risk",
                                          "overrun_recall": ev["overrun_recall"], "fold_scores": b.risk.scores})


def evaluate_bundle(trained: Trained) -> dict:
    """Test-set effort metrics and risk report of the ensembles (one small
    aggregate each)."""
    from ..operators import metrics as M
    test = trained.features.filter(F.col("split") == "test")
    e = trained.bundle.effort.ensemble(test)
    eff = M.evaluate_effort(e, "logged_days", "pred_days").first().asDict()
    out = {"effort": eff, "effort_cv": trained.bundle.effort.scores}
    if trained.bundle.risk is not None:
        r = trained.bundle.risk.ensemble(test)
        rep = {row["label"]: row.asDict() for row in M.classification_report(r, "risk_level", "pred_risk").collect()}
        out["risk"] = rep
        out["overrun_recall"] = rep["2"]["recall"]
        out["risk_cv"] = trained.bundle.risk.scores
    return out
