"""Registered queries: name -> f(spark, sf_dir) -> DataFrame.

Each reads the driver's tables (or views Spark derives from them) and runs
an operator of the library over the whole input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables as S
from . import prepare as PR

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def dataset(spark, sf):
    return PR.prepare_dataset(S.tickets(spark, sf))


LIGHT = ["ticket_id", "summary", "estimate", "logged_days", "risk_level", "region", "subsystem", "commitments"]


def labelled(spark, sf):
    """The dataset's columns that need no text: documents are not read."""
    return PR.prepare_dataset(S.tickets(spark, sf, documents=False)).select(*LIGHT)


@query
def q_prepare_dataset(spark, sf):
    return dataset(spark, sf)


@query
def q_text_features(spark, sf):
    t = S.tickets(spark, sf).withColumn("text", T.concat_text())
    return T.text_features(t).select("ticket_id", *T.FEATURE_COLUMNS)


@query
def q_risk_distribution(spark, sf):
    return PR.risk_distribution(labelled(spark, sf))


# ---------------------------------------------------------------- helpers
from ..functions import labels as L  # noqa: E402
from ..functions import parse as P  # noqa: E402
from ..operators import aggregates as A  # noqa: E402
from ..operators import ensemble as EN  # noqa: E402
from ..operators import joins as J  # noqa: E402
from ..operators import metrics as M  # noqa: E402
from ..operators import split as SP  # noqa: E402
from ..operators import topk as K  # noqa: E402
from ..sources import export as X  # noqa: E402
from ..sources import store as ST  # noqa: E402
from . import reports as R  # noqa: E402

PRED_LOGS = [f"pred_log_{k}" for k in range(S.N_FOLDS)]
PROBS = [[f"p0_{k}", f"p1_{k}", f"p2_{k}"] for k in range(S.N_FOLDS)]


def split_df(spark, sf):
    return SP.stratified_split(dataset(spark, sf))


def split_light(spark, sf):
    return SP.stratified_split(labelled(spark, sf))


def split_table(spark, sf, cols):
    """The split with its texts written once (read by several branches of a
    query); only ``cols`` are computed and written."""
    from ..session import materialize
    return materialize(split_df(spark, sf).select(*cols), "split")


def test_predictions_table(spark, sf):
    """Ensembled test-split predictions written once (reports read them in
    several branches)."""
    from ..session import materialize
    s = split_light(spark, sf).filter(F.col("split") == "test")
    return materialize(ensemble_of(s), "test-predictions")


def ensemble_of(ds):
    p = EN.ensemble_effort(S.with_fold_predictions(ds), PRED_LOGS)
    return EN.ensemble_risk(p, PROBS)


def ensembled(spark, sf):
    return ensemble_of(labelled(spark, sf))


def test_predictions(spark, sf):
    return ensemble_of(split_light(spark, sf).filter(F.col("split") == "test"))


def runs_latest(spark, sf):
    return K.upsert_latest(S.model_runs(spark, sf))


# ---------------------------------------------------------------- 2.2 scalar ops
@query
def q_fill_text(spark, sf):
    return T.fill_text(S.tickets(spark, sf, fill_description=False)).select("ticket_id", "summary", "description")


@query
def q_concat_text(spark, sf):
    t = S.tickets(spark, sf, fill_description=False)
    t = T.fill_text(t)
    return t.select("ticket_id", T.concat_text().alias("text"), T.concat_text(strip=True).alias("text_stripped"))


def _features(spark, sf, cols):
    t = S.tickets(spark, sf).withColumn("text", T.concat_text())
    exprs = T.text_feature_columns()
    return t.select("ticket_id", *[exprs[c].alias(c) for c in cols])


@query
def q_has_description(spark, sf):
    return _features(spark, sf, ["has_description"])


@query
def q_has_code_block(spark, sf):
    return _features(spark, sf, ["has_code_block"])


@query
def q_keyword_flags(spark, sf):
    return _features(spark, sf, ["is_dev_task", "is_test_task", "is_analysis_task"])


@query
def q_text_len(spark, sf):
    return _features(spark, sf, ["text_len"])


@query
def q_word_count(spark, sf):
    return _features(spark, sf, ["word_count"])


@query
def q_seconds_to_workdays(spark, sf):
    return S.tickets(spark, sf, documents=False).select("ticket_id", "time_spent", L.to_workdays("time_spent").alias("logged_days"))


@query
def q_parse_region(spark, sf):
    return S.tickets_raw(spark, sf).select("ticket_id", P.parse_region("region_raw").alias("region"))


@query
def q_parse_subsystem(spark, sf):
    return S.tickets_raw(spark, sf).select("ticket_id", P.parse_subsystem("subsystem_raw").alias("subsystem"))


@query
def q_parse_commitments(spark, sf):
    return S.tickets_raw(spark, sf).select("ticket_id", P.parse_commitments("commitments_raw").alias("commitments"))


@query
def q_filter_valid_tickets(spark, sf):
    t = S.tickets(spark, sf, documents=False).withColumn("logged_days", L.to_workdays("time_spent"))
    return L.filter_valid(t).select("ticket_id", "estimate", "logged_days")


@query
def q_risk_level(spark, sf):
    t = L.filter_valid(S.tickets(spark, sf, documents=False).withColumn("logged_days", L.to_workdays("time_spent")))
    return t.select("ticket_id", (F.col("logged_days") / F.col("estimate")).alias("ratio"),
                    L.risk_level().alias("risk_level"))


@query
def q_project_dataset(spark, sf):
    return dataset(spark, sf).select(*PR.DATASET_COLUMNS)


@query
def q_log_target(spark, sf):
    d = labelled(spark, sf)
    back = L.from_log(L.to_log("logged_days"))
    return d.select("ticket_id", L.to_log("logged_days").alias("y_log"),
                    (F.abs(back - F.col("logged_days")) <= 1e-9 * (1 + F.col("logged_days"))).alias("roundtrip_ok"))


@query
def q_delta_pct(spark, sf):
    fb = S.feedback(spark, sf)
    return fb.select("id", L.delta_pct("predicted_days", "actual_days").alias("delta_pct"))


@query
def q_delta_pct_abs(spark, sf):
    fb = S.feedback(spark, sf)
    return fb.select("id", L.delta_pct_abs("predicted_days", "actual_days").alias("delta_pct_abs"))


@query
def q_default_category(spark, sf):
    r = S.tickets_raw(spark, sf)
    return r.select("ticket_id", L.default_category("region_raw").alias("region"),
                    L.default_category(F.when(F.col("subsystem_raw") != "oops", F.col("subsystem_raw")),
                                       empty_is_missing=False).alias("subsystem"))


@query
def q_validate_summary(spark, sf):
    docs = S.read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("summary"))
    ok, bad = L.split_valid(docs)
    return (ok.select("doc_id", F.lit("accepted").alias("status"))
            .unionByName(bad.select("doc_id", F.lit("rejected").alias("status"))))


@query
def q_risk_buffer(spark, sf):
    e = ensembled(spark, sf)
    return e.select("ticket_id", L.risk_buffer_factor("p_medium", "p_critical").alias("buffer_factor"),
                    L.predicted_hours("pred_days").alias("predicted_hours"),
                    L.adjusted_hours("pred_days", "p_medium", "p_critical").alias("adjusted_hours"))


@query
def q_format_prediction(spark, sf):
    e = ensembled(spark, sf)
    f = e.select("ticket_id", *[v.alias(k) for k, v in L.format_prediction().items()])
    return f.select("ticket_id", "predicted_time_hours", "adjusted_time_with_buffer_hours",
                    "prediction_std_days", "risk_profile.*")


@query
def q_high_risk_flag(spark, sf):
    e = ensembled(spark, sf)
    f = e.select("ticket_id", *[v.alias(k) for k, v in L.format_prediction().items()])
    return f.select("ticket_id", L.high_risk_flag(F.col("risk_profile.critical_risk_prob_pct")).alias("high_risk"),
                    L.hours_to_days("predicted_time_hours").alias("predicted_days"))


@query
def q_fold_scores_json(spark, sf):
    r = S.model_runs(spark, sf)
    j = r.select("seq", L.fold_scores_to_json("fold_scores").alias("js"))
    return j.select("seq", L.fold_scores_from_json("js").alias("fold_scores"),
                    F.size(L.fold_scores_from_json(F.nullif(F.col("js"), F.lit("[]")))).alias("n_scores"))


@query
def q_cast_features(spark, sf):
    return L.cast_features(dataset(spark, sf)).select("ticket_id", *L.NUMERIC_FEATURES, *L.CATEGORICAL_FEATURES)


@query
def q_short_revision(spark, sf):
    return S.model_runs(spark, sf).select("seq", L.short_revision("run_id").alias("revision"))


# ---------------------------------------------------------------- 2.3 joins
@query
def q_join_features(spark, sf):
    emb = S.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("ticket_id"), "embedding")
    meta = labelled(spark, sf).select("ticket_id", "region", "subsystem", "commitments", "logged_days")
    return J.join_features(emb, meta)


def _baseline_preds(spark, sf):
    s = split_light(spark, sf)
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    return R.baseline_predictions(train, test)


@query
def q_lookup_with_fallback(spark, sf):
    return _baseline_preds(spark, sf).select("ticket_id", "pred_subsystem", "pred_region")


@query
def q_mark_feedback_used(spark, sf):
    fb = S.feedback(spark, sf)
    ids = ST.unused_rows(fb).filter(F.col("commitments") == "click").select("id")
    return J.mark_used(fb, ids).select("id", "is_used_for_training")


@query
def q_delete_matching(spark, sf):
    fb = S.feedback(spark, sf)
    keys = fb.filter(F.col("commitments") == "error").select("summary")
    return J.delete_matching(fb, keys).select("id", "summary")


# ---------------------------------------------------------------- 2.4 aggregates
@query
def q_feedback_counts(spark, sf):
    return A.feedback_counts(S.feedback(spark, sf))


@query
def q_feedback_metrics(spark, sf):
    return A.feedback_metrics(S.feedback(spark, sf))


@query
def q_target_profile(spark, sf):
    return A.target_profile(labelled(spark, sf))


@query
def q_category_profile(spark, sf):
    return A.category_profile(labelled(spark, sf))


@query
def q_global_median(spark, sf):
    return _baseline_preds(spark, sf).select("ticket_id", "pred_global")


@query
def q_group_median(spark, sf):
    s = split_light(spark, sf).filter(F.col("split") == "train")
    return R.group_medians(s, "subsystem")


def _yp(spark, sf):
    return ensembled(spark, sf).select("ticket_id", F.col("logged_days").alias("y"), F.col("pred_days").alias("p"))


@query
def q_r2(spark, sf):
    return M.r2(_yp(spark, sf))


@query
def q_mae(spark, sf):
    return M.mae(_yp(spark, sf))


@query
def q_rmse(spark, sf):
    return M.rmse(_yp(spark, sf))


@query
def q_error_distribution(spark, sf):
    return M.error_distribution(_yp(spark, sf))


@query
def q_mdape(spark, sf):
    return M.mdape(_yp(spark, sf))


@query
def q_grouped_errors(spark, sf):
    return M.grouped_errors(R.with_errors(ensembled(spark, sf)), "region")


@query
def q_percentile_bounds(spark, sf):
    cv = split_light(spark, sf).filter(F.col("split").isin("train", "val"))
    return SP.fold_bounds(SP.kfold_assign(cv))


@query
def q_classification_report(spark, sf):
    e = ensembled(spark, sf)
    return M.classification_report(e, "risk_level", "pred_risk")


@query
def q_fold_summary(spark, sf):
    r = runs_latest(spark, sf).select("run_id", F.explode("fold_scores").alias("score"))
    return A.fold_summary(r, "score", by=["run_id"])


@query
def q_class_weights(spark, sf):
    return A.class_weights(labelled(spark, sf))


@query
def q_row_accounting(spark, sf):
    return A.row_accounting(S.tickets(spark, sf, documents=False), labelled(spark, sf))


@query
def q_hours_saved(spark, sf):
    fb = S.feedback(spark, sf).agg(F.count(F.lit(1)).alias("feedbacks_collected"))
    return fb.withColumn("hours_saved", L.hours_saved(F.col("feedbacks_collected")))


# ---------------------------------------------------------------- 2.5 top-k
@query
def q_latest_model_run(spark, sf):
    return K.latest_model_run(runs_latest(spark, sf).drop("seq"))


@query
def q_top_subsystems_by_mae(spark, sf):
    g = M.grouped_errors(R.with_errors(test_predictions(spark, sf)), "subsystem", decimals=None)
    top = K.top_n_groups(g, "subsystem", 10)
    return top.withColumns({"mae": F.bround("mae", 2), "median_actual": F.bround("median_actual", 2)})


@query
def q_worst_predictions(spark, sf):
    return K.worst_predictions(R.with_errors(ensembled(spark, sf)))


@query
def q_recent_feedback(spark, sf):
    return K.recent(S.feedback(spark, sf), 5, "id").select("id", "summary", "predicted_days", "actual_days")


@query
def q_recent_runs(spark, sf):
    r = runs_latest(spark, sf)
    top = K.top_k_per_group(r, ["model_type"], [F.col("created_at").desc(), F.col("run_id").desc()], 3)
    return top.select("model_type", "rank", "run_id",
                      *[F.bround(c, 4).alias(c) for c in ["r2", "mae", "rmse", "overrun_recall"]])


# ---------------------------------------------------------------- 2.6 set ops
@query
def q_union_train_val(spark, sf):
    s = split_light(spark, sf)
    return SP.union_cv(s.filter(F.col("split") == "train"), s.filter(F.col("split") == "val")) \
        .select("ticket_id", "split")


@query
def q_unused_feedback_rows(spark, sf):
    return ST.unused_rows(S.feedback(spark, sf))


# ---------------------------------------------------------------- 2.7 split / CV
@query
def q_stratified_split(spark, sf):
    return SP.split_labels(labelled(spark, sf))


@query
def q_kfold_assign(spark, sf):
    cv = SP.split_labels(labelled(spark, sf)).filter(F.col("split").isin("train", "val"))
    return SP.kfold_labels(cv)


@query
def q_fold_outlier_trim(spark, sf):
    cv = SP.kfold_assign(split_light(spark, sf).filter(F.col("split").isin("train", "val")))
    roles = SP.fold_roles(cv)
    return roles.groupBy("cv_fold", "role").agg(F.count(F.lit(1)).alias("n_rows"),
                                               F.min("logged_days").alias("min_y"),
                                               F.max("logged_days").alias("max_y"))


# ---------------------------------------------------------------- 2.9 ensembles and evaluation
@query
def q_ensemble_effort(spark, sf):
    return ensembled(spark, sf).select("ticket_id", "pred_log", "pred_days", "pred_std_days")


@query
def q_ensemble_risk(spark, sf):
    return ensembled(spark, sf).select("ticket_id", "p_low", "p_medium", "p_critical", "pred_risk")


@query
def q_evaluate_effort(spark, sf):
    t = test_predictions(spark, sf)
    return M.evaluate_effort(t, "logged_days", "pred_days")


@query
def q_evaluate_risk(spark, sf):
    return M.evaluate_risk(test_predictions_table(spark, sf), "risk_level", "pred_risk")


# ---------------------------------------------------------------- 2.10 reports
@query
def q_baseline_report(spark, sf):
    s = split_light(spark, sf)
    train = s.filter(F.col("split") == "train")
    test = ensemble_of(s.filter(F.col("split") == "test"))
    return R.baseline_report(train, test, model_pred_log="pred_log")


@query
def q_error_report(spark, sf):
    return R.error_report(test_predictions_table(spark, sf))


@query
def q_metrics_report(spark, sf):
    return R.metrics_report(runs_latest(spark, sf), S.feedback(spark, sf))


@query
def q_model_status(spark, sf):
    return R.model_status(runs_latest(spark, sf))


# ---------------------------------------------------------------- 2.1 sources (table-level)
@query
def q_filter_issue_export(spark, sf):
    t = S.tickets(spark, sf, documents=False).withColumn("project", F.col("region"))
    return X.filter_export(t, "ASIA").select("ticket_id", "created_at", "estimate", "time_spent")


@query
def q_model_runs_upsert(spark, sf):
    return runs_latest(spark, sf).select("run_id", "seq", "model_type", "trigger", "r2")


@query
def q_runs_insert_if_absent(spark, sf):
    existing = runs_latest(spark, sf)
    defaults = spark.createDataFrame(
        [("first-estimate", "seed", "estimate", 0.25, 2.0, 3.5, None),
         ("first-anomaly", "seed", "anomaly", None, None, None, 0.75)],
        "run_id string, trigger string, model_type string, r2 double, mae double, rmse double, "
        "overrun_recall double")
    return ST.insert_if_absent(existing.select("run_id", "trigger", "model_type", "r2", "mae", "rmse",
                                               "overrun_recall"), defaults)


@query
def q_feedback_schema_evolve(spark, sf):
    fb = S.feedback(spark, sf).select("id", "created_at", "summary", "description")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old = fb.filter(F.col("created_at") < cut).drop("description")
    new = fb.filter(F.col("created_at") >= cut)
    return ST.union_evolved(old, new, {"description": ""}).select("id", "description")


# ---------------------------------------------------------------- 2.8 text
from ..operators import text as TX  # noqa: E402


def _docs(spark, sf):
    return S.read_table(spark, sf, "documents").select(F.col("doc_id"), F.col("text"))


@query
def q_tokenize(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.tokens("text").alias("tokens"))


@query
def q_vocabulary_stats(spark, sf):
    return TX.vocabulary_stats(TX.term_counts(_docs(spark, sf), "doc_id"), "doc_id")


@query
def q_vocabulary_topk(spark, sf):
    stats = TX.vocabulary_stats(TX.term_counts(_docs(spark, sf), "doc_id"), "doc_id")
    return TX.vocabulary(stats, min_df=2, max_features=25_000)


def _tfidf_model(spark, sf):
    s = split_table(spark, sf, ["ticket_id", "text", "split"])
    model, weights = TX.fit_transform_tfidf(s, F.col("split") == "train")
    return s, model, weights


@query
def q_tfidf(spark, sf):
    return _tfidf_model(spark, sf)[2]


_LSA: dict = {}


def _inputs(spark, sf):
    """Identity of the application and of the files a model was fitted on."""
    files = [f for t in ("orders", "customer", "documents") for f in sorted(S.read_table(spark, sf, t).inputFiles())]
    return spark.sparkContext.applicationId, *files


def _lsa(spark, sf, k=32):
    """Fit once per application and input (fitted models in the driver; the
    tables they refer to are written to the checkpoint folder)."""
    key = (*_inputs(spark, sf), k)
    if key not in _LSA:
        s = split_table(spark, sf, ["ticket_id", "text", "split"])
        model, weights = TX.fit_transform_rows(s, F.col("split") == "train")
        train_w = weights.join(s.filter(F.col("split") == "train").select("ticket_id"), "ticket_id", "left_semi")
        _LSA[key] = (s, model, weights, train_w, TX.fit_lsa(train_w, model.size, k))
    return _LSA[key]


@query
def q_lsa_fit(spark, sf):
    """Per component what holds of any truncated SVD: unit length, orthogonal to
    the others, descending singular values, the largest entry positive."""
    import numpy as np
    lsa = _lsa(spark, sf)[-1]
    v, s = lsa.components, lsa.singular_values
    gram = np.abs(v.T @ v - np.eye(len(s)))
    rows = [(j, bool(gram[j].max() < 1e-6), bool(s[j] > 0 and (j == 0 or s[j] <= s[j - 1] * (1 + 1e-9))),
             bool(v[np.abs(v[:, j]).argmax(), j] > 0)) for j in range(len(s))]
    return spark.createDataFrame(rows, "component int, orthonormal boolean, descending boolean, sign_ok boolean")


@query
def q_lsa_transform(spark, sf):
    """Every ticket's embedding: its dimension, and whether it is zero exactly if
    the text has no known term."""
    s, model, weights, _, lsa = _lsa(spark, sf)
    known = weights.select("ticket_id").distinct().withColumn("known", F.lit(True))
    zero = ~F.exists("embedding", lambda x: x != 0)
    return (lsa.transform(weights, docs=s).join(known, "ticket_id", "left")
            .select("ticket_id", F.size("embedding").alias("dimension"),
                    (zero == F.col("known").isNull()).alias("zero_flag_ok")))


@query
def q_explained_variance(spark, sf):
    """The share of variance, against the same number from the embedding's
    own variances and the term variances computed another way."""
    s, model, _, train_w, lsa = _lsa(spark, sf)
    train = s.filter(F.col("split") == "train")
    k = lsa.components.shape[1]
    emb = lsa.transform(train_w, docs=train)
    train_w = TX.long_weights(train_w)
    got = TX.explained_variance(train_w, emb, model.n_docs, k).first()[0]
    n = float(model.n_docs)
    top = emb.agg(sum(F.var_pop(F.col("embedding")[i]) for i in range(k))).first()[0]
    term = train_w.groupBy("term_idx").agg((F.sum(F.col("weight") ** 2) / n).alias("e2"), (F.sum("weight") / n).alias("e1"))
    whole = term.agg(F.sum(F.col("e2") - F.col("e1") * F.col("e1"))).first()[0]
    return spark.createDataFrame([(abs(got - top / whole) < 1e-6, 0 < got < 1)], "agrees boolean, in_range boolean")


# ---------------------------------------------------------------- 2.9 models (rows-only checks)
import os as _os  # noqa: E402
import uuid as _uuid  # noqa: E402

from ..operators import explain as XP  # noqa: E402
from ..operators import models as MD  # noqa: E402
from ..session import checkpoint_dir  # noqa: E402
from . import train as TR  # noqa: E402

_TRAINED: dict = {}


def trained(spark, sf):
    """Train once per application and input; the fitted models (not data)
    are kept in the driver, data stays in Spark."""
    key = _inputs(spark, sf)
    if key not in _TRAINED:
        _TRAINED[key] = TR.train_all(dataset(spark, sf))
    return _TRAINED[key]


def _scratch(spark, name):
    return _os.path.join(checkpoint_dir(spark), "queries", f"{name}-{_uuid.uuid4().hex}")


@query
def q_encode_categoricals(spark, sf):
    t = trained(spark, sf)
    return t.bundle.indexer.transform(MD.with_default_categories(labelled(spark, sf))).select("ticket_id", *MD.IDX)


@query
def q_train_effort_cv(spark, sf):
    """Rows that each effort fold was trained (trimmed) and validated on, and
    whether it has a score."""
    t = trained(spark, sf)
    scores = spark.createDataFrame([(k, s == s) for k, s in enumerate(t.bundle.effort.scores)], "cv_fold int, scored boolean")
    roles = SP.fold_roles(t.features.filter("fold is not null").select("ticket_id", "fold", "logged_days"))
    n = roles.groupBy("cv_fold").agg(F.count_if(F.col("role") == "train").alias("n_train"),
                                     F.count_if(F.col("role") == "val").alias("n_val"))
    return n.join(scores, "cv_fold").withColumnRenamed("cv_fold", "fold")


@query
def q_train_risk_cv(spark, sf):
    """Rows that each risk fold was trained and validated on, and whether its
    accuracy is a share."""
    t = trained(spark, sf)
    scores = spark.createDataFrame([(k, 0 <= s <= 1) for k, s in enumerate(t.bundle.risk.scores)], "fold int, scored boolean")
    n = t.features.filter("fold is not null").groupBy("fold").agg(F.count(F.lit(1)).alias("n_val"))
    total = n.agg(F.sum("n_val")).scalar()
    return n.withColumn("n_train", total - F.col("n_val")).join(scores, "fold")


@query
def q_score_batch(spark, sf):
    """Every ticket scored: probabilities that sum to 1, hours of the predicted
    days, and the buffer of the probabilities."""
    out = trained(spark, sf).bundle.score(S.tickets(spark, sf))
    total = F.col("p_low") + F.col("p_medium") + F.col("p_critical")
    factor = 1 + L.MEDIUM_RISK_BUFFER * F.col("p_medium") + L.CRITICAL_RISK_BUFFER * F.col("p_critical")
    hours = F.col("pred_days") * L.WORKDAY_HOURS
    return out.select("ticket_id", (F.abs(total - 1) < 1e-6).alias("probabilities_ok"),
                      (F.abs(F.col("predicted_time_hours") - hours) <= 0.051).alias("hours_ok"),
                      (F.abs(F.col("adjusted_time_with_buffer_hours") - hours * factor) <= 0.051).alias("buffer_ok"),
                      (F.col("pred_days") >= 0).alias("days_ok"))


@query
def q_explain(spark, sf):
    """Every ticket explained: base value plus contributions against the fold's
    own prediction."""
    t = trained(spark, sf)
    ex = XP.explain(t.bundle.features(S.tickets(spark, sf)), t.bundle)
    total = F.col("base_log") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return ex.select("ticket_id", (F.abs(total - F.col("pred_log")) < 1e-6).alias("adds_up"),
                     F.size("top_features").alias("n_top"))


def _contributions(spark, sf):
    """The embedding table's vectors as contributions of 64 features."""
    e = S.read_table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("contributions"))


@query
def q_top_features(spark, sf):
    c = _contributions(spark, sf)
    pairs = F.transform("contributions", lambda v, i: F.struct(F.format_string("f%02d", i).alias("feature"), v.alias("shap_value")))
    top = c.select("vec_id", F.posexplode(K.top_features(pairs, 10)).alias("rank", "t"))
    return top.select("vec_id", "rank", "t.feature", "t.shap_value")


@query
def q_mean_abs_shap(spark, sf):
    return XP.mean_abs_shap(_contributions(spark, sf), [f"f{i:02d}" for i in range(64)], 20)


@query
def q_save_load_models(spark, sf):
    """Every ticket scored by the models and by the models saved and loaded again."""
    t = trained(spark, sf)
    path = _scratch(spark, "bundle")
    MD.save_bundle(t.bundle, path)
    loaded = MD.load_bundle(spark, path)
    every = S.tickets(spark, sf)
    a = t.bundle.score(every).select("ticket_id", F.col("pred_days").alias("saved"), F.col("p_critical").alias("p"))
    b = loaded.score(every).select("ticket_id", F.col("pred_days").alias("loaded"), F.col("p_critical").alias("p2"))
    same = (F.abs(F.col("saved") - F.col("loaded")) < 1e-9) & (F.abs(F.col("p") - F.col("p2")) < 1e-9)
    return a.join(b, "ticket_id").select("ticket_id", same.alias("same"))


@query
def q_write_embeddings(spark, sf):
    t = trained(spark, sf)
    path = _scratch(spark, "embeddings")
    ST.write_embeddings(t.features, path)
    return ST.read_embeddings(spark, path).select("ticket_id", F.size("embedding").alias("dimension"), "logged_days",
                                                  "risk_level", "split")


@query
def q_log_run_metrics(spark, sf):
    t = trained(spark, sf)
    path = _scratch(spark, "run-metrics")
    ev = TR.evaluate_bundle(t)
    run = t.bundle.run_id
    ST.log_metrics(spark, path, run, {"max_iter": MD.EffortParams().max_iter, "max_depth": MD.EffortParams().max_depth,
                                      "n_folds": len(t.bundle.effort.models)}, kind="param")
    for k, s in enumerate(t.bundle.effort.scores):
        ST.log_metrics(spark, path, run, {f"fold_{k}_r2": s}, step=k)
    ST.log_metrics(spark, path, run, {f"test_{m}": ev["effort"][m] for m in ("r2", "mae", "rmse")})
    ST.log_metrics(spark, path, run, {"test_overrun_recall": ev["overrun_recall"]})
    return spark.read.parquet(path).select("kind", "name", "step", F.col("value").isNotNull().alias("has_value"))


@query
def q_score_stream(spark, sf):
    from ..streaming import jobs as SJ
    t = trained(spark, sf)
    src = _scratch(spark, "requests")
    S.tickets(spark, sf).select(*SJ.REQUEST_SCHEMA.fieldNames()).repartition(4).write.parquet(src)
    sink = _scratch(spark, "scored")
    q = SJ.score_stream(spark, src, t.bundle, sink, _scratch(spark, "ckpt"), max_files_per_trigger=2)
    q.awaitTermination()
    streamed = spark.read.parquet(sink).select("ticket_id", F.col("pred_days").alias("streamed"))
    batch = t.bundle.score(S.tickets(spark, sf)).select("ticket_id", "pred_days")
    return batch.join(streamed, "ticket_id").select(
        "ticket_id", (F.abs(F.col("pred_days") - F.col("streamed")) < 1e-9).alias("same_as_batch"))


def _feedback_requests(spark, sf):
    fb = S.feedback(spark, sf)
    return fb.select(F.col("id").alias("ticket_id"), "summary", "description", "region", "subsystem", "commitments",
                     "predicted_days", "actual_days")


@query
def q_feedback_append(spark, sf):
    path = _scratch(spark, "feedback")
    ST.append_feedback(_feedback_requests(spark, sf), path, batch_id=0)
    ST.append_feedback(_feedback_requests(spark, sf), path, batch_id=0)      # replay: no duplicates
    # Generated id and write time are not reproducible outside the store.
    return ST.read_feedback(spark, path).drop("id", "created_at")


@query
def q_feedback_stream(spark, sf):
    from ..streaming import jobs as SJ
    src = _scratch(spark, "fb-requests")
    _feedback_requests(spark, sf).repartition(4).write.parquet(src)
    path, totals = _scratch(spark, "feedback"), _scratch(spark, "feedback-totals")
    q = SJ.feedback_stream(spark, src, path, _scratch(spark, "ckpt"), totals_path=totals, max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(totals).orderBy(F.col("batch_id").desc()).limit(1).drop("batch_id")     # after the last batch


@query
def q_retrain_job(spark, sf):
    from . import jobs as JB
    t = trained(spark, sf)
    fb_path, marks, runs = _scratch(spark, "feedback"), _scratch(spark, "marks"), _scratch(spark, "runs")
    ST.append_feedback(_feedback_requests(spark, sf), fb_path, batch_id=0)
    bundle = MD.Bundle(t.bundle.tfidf, t.bundle.lsa, t.bundle.indexer, t.bundle.effort, t.bundle.risk, t.bundle.run_id)
    models, metrics = _scratch(spark, "models"), _scratch(spark, "run-metrics")
    res = JB.retrain_job(spark, bundle, t.splits, fb_path, marks, runs, models_path=models, metrics_path=metrics)
    after = A.feedback_counts(ST.read_feedback(spark, fb_path, marks)).first()
    recorded = ST.read_runs(spark, runs).filter(F.col("run_id") == res.run_id).count() == 1
    loaded = MD.load_bundle(spark, f"{models}/{res.run_id}")
    logged = spark.read.parquet(metrics).filter((F.col("run_id") == res.run_id) & F.col("name").startswith("test_")).count()
    return spark.createDataFrame([(res.status, res.unused, after["unused"], recorded, loaded.run_id == res.run_id, logged)],
                                 "status string, unused_before long, unused_after long, run_recorded boolean, "
                                 "bundle_loadable boolean, test_metrics long")


@query
def q_retrain_trigger(spark, sf):
    from ..streaming import jobs as SJ
    from . import jobs as JB
    t = trained(spark, sf)
    src = _scratch(spark, "fb-requests")
    _feedback_requests(spark, sf).repartition(3).write.parquet(src)
    fb_path, marks, runs = _scratch(spark, "feedback"), _scratch(spark, "marks"), _scratch(spark, "runs")
    bundle = MD.Bundle(t.bundle.tfidf, t.bundle.lsa, t.bundle.indexer, t.bundle.effort, t.bundle.risk, t.bundle.run_id)
    trig = SJ.RetrainTrigger(spark, lambda: JB.retrain_job(spark, bundle, t.splits, fb_path, marks, runs,
                                                           params=MD.EffortParams(max_iter=10)),
                             fb_path, marks)
    q = SJ.retrain_trigger_stream(spark, src, trig, _scratch(spark, "ckpt"))
    q.awaitTermination()
    counts = A.feedback_counts(ST.read_feedback(spark, fb_path, marks)).first()
    return ST.read_runs(spark, runs).groupBy("trigger", "model_type").agg(
        (F.count(F.lit(1)) >= 1).alias("recorded"), F.lit(counts["total"]).alias("feedback"),
        F.lit(counts["unused"]).alias("unused_after"))


# ---------------------------------------------------------------- 2.1 sources (files)
from ..sources import csv as CSV  # noqa: E402


@query
def q_read_seed_csv(spark, sf):
    path = _scratch(spark, "seed-csv")
    seed = S.seed(spark, sf).select(F.col("ticket_id").cast("string").alias("key"), "summary", "description",
                                   "time_spent", "estimate", "region", "subsystem", "commitments")
    (seed.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return CSV.read_seed(spark, path)


@query
def q_read_features_csv(spark, sf):
    path = _scratch(spark, "splits-csv")
    CSV.write_splits(split_df(spark, sf).select(*PR.DATASET_COLUMNS, "split"), path, fmt="csv")
    return CSV.read_split(spark, path + "/split=train", keep_empty=True)


@query
def q_write_splits(spark, sf):
    path = _scratch(spark, "splits")
    CSV.write_splits(split_df(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def q_flatten_issues(spark, sf):
    path = _scratch(spark, "issue-pages")
    t = S.tickets(spark, sf)
    issue = F.struct(
        F.concat(F.lit("T-"), F.col("ticket_id").cast("string")).alias("key"),
        F.struct(F.col("summary"), F.when(F.col("description") != "", F.col("description")).alias("description"),
                 F.col("time_spent").cast("double").alias("timespent"),
                 F.col("created_at").cast("string").alias("created"), F.col("status"),
                 F.col("region").alias("project"),
                 F.col("estimate").alias(X.STORY_POINTS_FIELD),
                 F.when(F.col("ticket_id") % 5 != 0, F.array(F.struct(F.col("region").alias("value")))).alias(X.REGION_FIELD),
                 F.struct(F.col("region").alias("value"), F.struct(F.col("subsystem").alias("value")).alias("child"))
                  .alias(X.SUBSYSTEM_FIELD),
                 F.struct(F.col("commitments").alias("value")).alias(X.COMMITMENTS_FIELD)).alias("fields"))
    # Pages of at most 1000 issues, as the export API returns them.
    pages = t.groupBy(F.floor(F.col("ticket_id") / 1000).alias("page")).agg(
        F.count(F.lit(1)).alias("total"), F.collect_list(issue).alias("issues"))
    pages.select("total", "issues").write.option("compression", "gzip").json(path)
    return X.flatten_issues(X.read_issue_pages(spark, path, one_page_per_file=False))


@query
def q_augment_with_feedback(spark, sf):
    from . import jobs as JB
    cv = split_df(spark, sf).filter(F.col("split").isin("train", "val"))
    return JB.augment(cv, ST.unused_rows(S.feedback(spark, sf)))


@query
def q_prepare_dataset_raw(spark, sf):
    """seed (option fields as literal text) -> dataset, parsing included."""
    return PR.prepare_dataset(S.seed(spark, sf), parse_literals=True)
