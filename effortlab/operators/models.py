"""Fold ensembles trained with Spark ML.

* categoricals: ``StringIndexer`` (unseen -> extra index), then smoothed means
  of the target from each fold's *training* part: a ``TargetEncoder`` for rows
  that are scored, ordered target statistics (see :mod:`target_stats`) for the
  training rows, so that no row meets its own target;
* effort: ``GBTRegressor`` on log1p(days), early-stopped on the fold's
  validation part (``validationIndicatorCol``), training part trimmed to its
  p1..p99; fold score = R² in days after clipping;
* risk: a boosted learner per class against the others (``GBTClassifier``),
  with balanced class weights and early-stopped like effort, their
  probabilities renormalised; or a weighted ``RandomForestClassifier``; fold
  score = accuracy.

The CV frame is written once; a fold is a filter on the ``fold`` column.
Fold models are scored on the same rows, so the ensemble needs no shuffle: boosted
ones as arrays (see :mod:`scoring`), others by chaining their transforms.
"""

from __future__ import annotations

import json
import os
import threading
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, TargetEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from . import ensemble as EN
from . import scoring as SC
from . import split as SP
from . import text as TX
from ..session import materialize
from .aggregates import class_weights
from .metrics import r2_expr
from .target_stats import ordered_target_stats, range_count

CATS = L.CATEGORICAL_FEATURES
NUMS = L.NUMERIC_FEATURES
IDX = [f"{c}_idx" for c in CATS]
TE = [f"{c}_te" for c in CATS]
# Encoded means as plain numbers: the encoder copies the indexer's nominal
# metadata to its outputs, which would make trees treat them as category ids.
TE_NUM = [f"{c}_enc" for c in CATS]
#: The risk levels.
RISK_CLASSES = (0, 1, 2)
IS_CLASS = [f"is_{c}" for c in RISK_CLASSES]


#: Fold models saved or loaded at a time: each is some dozen jobs on tiny tables.
IO_THREADS = 8


#: Bytes that a learner keeps of a training row, about: its binned features, its prediction and error of two rounds.
ROW_BYTES = 450


@dataclass
class EffortParams:
    max_iter: int = 30
    max_depth: int = 5
    step_size: float = 0.1
    validation_tol: float = 0.001
    smoothing: float = 10.0
    seed: int = 42


@dataclass
class RiskParams:
    """``learner``: 'boosted' (max_iter trees a class at most) or 'forest' (num_trees)."""
    learner: str = "boosted"
    max_iter: int = 20
    step_size: float = 0.1
    validation_tol: float = 0.001
    num_trees: int = 40
    max_depth: int = 5
    smoothing: float = 10.0
    seed: int = 42


def with_default_categories(df: DataFrame) -> DataFrame:
    """Null, empty or absent categories become 'Unknown'."""
    return df.withColumns({c: L.default_category(c) if c in df.columns else F.lit(L.UNKNOWN) for c in CATS})


def category_indexer(df: DataFrame) -> StringIndexerModel:
    """Index the three categoricals.  A missing value is the category 'Unknown'
    like any other; values not seen here get the extra index."""
    return StringIndexer(inputCols=CATS, outputCols=IDX, handleInvalid="keep").fit(with_default_categories(df))


def model_input(df: DataFrame, emb: str = "embedding") -> DataFrame:
    """Numeric features as double, embedding as a dense vector."""
    cols = {c: F.col(c).cast("double") for c in NUMS}
    cols["emb_vec"] = array_to_vector(F.col(emb))
    return df.withColumns(cols)


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=["emb_vec", *NUMS, *TE_NUM], outputCol="features")


def _plain_encodings() -> SQLTransformer:
    cols = ", ".join(f"CAST({t} + 0.0 AS DOUBLE) AS {n}" for t, n in zip(TE, TE_NUM))
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


def _target_encoder(label: str, smoothing: float) -> TargetEncoder:
    return TargetEncoder(inputCols=IDX, outputCols=TE, labelCol=label, targetType="continuous",
                         handleInvalid="keep", smoothing=smoothing)


def _class_probabilities(scored: DataFrame) -> Column:
    """Array of class probabilities of a risk model's output; those of one
    learner per class are renormalised to sum 1."""
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))
    each = [vector_to_array(F.col(f"probability_{c}"))[1] for c in RISK_CLASSES]
    return F.array(*[p / sum(each[1:], each[0]) for p in each])


@dataclass
class FoldEnsemble:
    kind: str                               # 'effort' | 'risk'
    models: list[PipelineModel]
    scores: list[float] = field(default_factory=list)
    arrays: tuple | None = field(default=None, init=False, repr=False, compare=False)       # read from the models once

    def transform(self, df: DataFrame, prefix: str | None = None) -> DataFrame:
        """Add one prediction column per fold (effort: ``pred_log_k``, risk:
        ``prob_k`` arrays), keeping only the input columns besides."""
        if self.arrays is None or self.arrays[0] != self.models:
            self.arrays = (list(self.models), SC.fold_arrays(self.models, NUMS, IDX, TE_NUM, df.sparkSession))
        folds = self.arrays[1]
        if folds is not None and all(len(f.learners) == (1 if self.kind == "effort" else len(RISK_CLASSES)) for f in folds):
            return self._transform_arrays(df, folds, prefix)
        return self._transform_stages(df, prefix)

    def _transform_arrays(self, df: DataFrame, folds: list[SC.FoldArrays], prefix: str | None) -> DataFrame:
        values = df.withColumn("_values", SC.fold_values(df, folds, NUMS, IDX))
        if self.kind == "effort":
            found = [F.col("_values")[k] for k in range(len(folds))]
        else:
            # Probability of a learner's class from its margin, as the boosted classifier has it.
            values = values.withColumn("_values", F.transform("_values", lambda m: 1.0 / (1.0 + F.exp(-2.0 * m))))
            each = [[F.col("_values")[len(RISK_CLASSES) * k + c] for c in range(len(RISK_CLASSES))] for k in range(len(folds))]
            found = [F.array(*[p / sum(some[1:], some[0]) for p in some]) for some in each]
        name = prefix or ("pred_log" if self.kind == "effort" else "prob")
        return values.select(*df.columns, *[v.alias(f"{name}_{k}") for k, v in enumerate(found)])

    def _transform_stages(self, df: DataFrame, prefix: str | None = None) -> DataFrame:
        keep = list(df.columns)
        out = df
        for k, m in enumerate(self.models):
            scored = m.transform(out)
            if self.kind == "effort":
                col = F.col("prediction").alias(f"{prefix or 'pred_log'}_{k}")
            else:
                col = _class_probabilities(scored).alias(f"{prefix or 'prob'}_{k}")
            out = scored.select(*keep, col)
            keep.append(f"{prefix or ('pred_log' if self.kind == 'effort' else 'prob')}_{k}")
        return out

    def ensemble(self, df: DataFrame) -> DataFrame:
        scored = self.transform(df)
        n = len(self.models)
        if self.kind == "effort":
            return EN.ensemble_effort(scored, [f"pred_log_{k}" for k in range(n)])
        return EN.ensemble_risk_arrays(scored, [f"prob_{k}" for k in range(n)])


def _training_rows(df: DataFrame, *more: str) -> DataFrame:
    """Model inputs, fold and the columns in ``more``: written once, each row
    under a number of its own."""
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    return materialize(rows.select("_row", "fold", "emb_vec", *NUMS, *IDX, *more), "cv")


def _encoded(data: DataFrame, training: dict[int, Column], label: str, smoothing: float, seed: int) -> DataFrame:
    """``data`` with its encodings as a training row of every fold (by the rows
    before it), for all folds at once: written once and kept at hand, for learners
    pass over their rows many times."""
    stats = ordered_target_stats(data, dict(zip(IDX, TE)), label, "_row", smoothing=smoothing, seed=seed,
                                 ranges=range_count(data.count()), sets={f"_{k}": met for k, met in training.items()})
    return materialize(stats, "encoded").persist(StorageLevel.MEMORY_AND_DISK)


def _fold_rows(data: DataFrame, training: dict[int, Column], k: int, label: str, smoothing: float):
    """The fold's encoder, and its training and validation rows: validation rows
    are encoded as scored ones are."""
    own = [f"{c}_{j}" for j in training for c in TE]
    train, val = data.filter(training[k]), data.filter(F.col("fold") == k)
    te = _target_encoder(label, smoothing).fit(train)
    train = train.withColumns({c: F.col(f"{c}_{k}") for c in TE}).drop(*own).withColumn("is_val", F.lit(False))
    return te, train.unionByName(te.transform(val.drop(*own)).withColumn("is_val", F.lit(True)))


def _run_folds(fit_fold, folds: int, parallelism: int):
    """Fit the folds from a small driver thread pool: each fold's jobs are
    small, so concurrent folds keep the executors busy.  Every fold is
    seeded, so results do not depend on the concurrency."""
    from concurrent.futures import ThreadPoolExecutor
    if parallelism <= 1:
        return [fit_fold(k) for k in range(folds)]
    with ThreadPoolExecutor(max_workers=min(parallelism, folds)) as pool:
        return list(pool.map(fit_fold, range(folds)))


def storage_bytes(spark: SparkSession) -> int:
    """What the executors can keep of cached rows."""
    sc = spark.sparkContext._jsc.sc()
    driver, sizes = sc.env().blockManager().blockManagerId().hostPort(), {}
    each = sc.getExecutorMemoryStatus().iterator()
    while each.hasNext():
        e = each.next()
        sizes[e._1()] = e._2()._1()
    if len(sizes) > 1:                                               # the driver keeps no rows
        sizes.pop(driver, None)
    return sum(sizes.values())


class Room:
    """Bytes that the learners of this driver hold at a time, of all ensembles that are trained.  A learner
    that finds no room waits, unless nothing is held: its rows would be written to disk and
    read again at every level of every tree."""

    def __init__(self):
        self.held, self.change = 0, threading.Condition()

    @contextmanager
    def take(self, size: int, most: int):
        with self.change:
            self.change.wait_for(lambda: not self.held or self.held + size <= most)
            self.held += size
        try:
            yield
        finally:
            with self.change:
                self.held -= size
                self.change.notify_all()


ROOM = Room()


def in_room(fit, size: int, most: int):
    """``fit`` for when there is room for ``size`` more bytes."""
    def run(k):
        with ROOM.take(size, most):
            return fit(k)
    return run


def side_by_side(tasks: list):
    """Results of the tasks, in their order, each run by a driver thread of its own."""
    return _run_folds(lambda i: tasks[i](), len(tasks), len(tasks))


def train_effort_cv(cv: DataFrame, folds: int = 5, target: str = "logged_days",
                    params: EffortParams | None = None, parallelism: int = 5) -> FoldEnsemble:
    """``cv`` carries model inputs, ``fold`` and the target (days)."""
    p = params or EffortParams()
    data = _training_rows(cv.filter(F.col(target).isNotNull()).withColumn("y_log", F.log1p(F.col(target))),
                          target, "y_log")
    bounds = {r["fold"]: (r["lower"], r["upper"]) for r in SP.fold_bounds(data, folds, target).collect()}
    training = {k: (F.col("fold") != k) & F.col(target).between(*bounds[k]) for k in range(folds)}
    size, most = ROW_BYTES * data.count(), storage_bytes(cv.sparkSession)
    data = _encoded(data, training, "y_log", p.smoothing, p.seed)
    try:
        def fit_fold(k):
            held = data.filter(F.col("fold") == k)
            te, both = _fold_rows(data, training, k, "y_log", p.smoothing)
            gbt = GBTRegressor(labelCol="y_log", featuresCol="features", maxIter=p.max_iter,
                               maxDepth=p.max_depth, stepSize=p.step_size, seed=p.seed + k,
                               validationIndicatorCol="is_val", validationTol=p.validation_tol)
            fitted = Pipeline(stages=[_plain_encodings(), _assembler(), gbt]).fit(both)
            model = PipelineModel(stages=[te, *fitted.stages])
            score = model.transform(held).agg(r2_expr(F.col(target), F.greatest(F.expm1("prediction"), F.lit(0.0)))).first()[0]
            return model, float(score) if score is not None else float("nan")

        out = _run_folds(in_room(fit_fold, size, most), folds, parallelism)
        return FoldEnsemble("effort", [m for m, _ in out], [sc for _, sc in out])
    finally:
        data.unpersist()


def _risk_learners(p: RiskParams, seed: int) -> list:
    if p.learner == "forest":
        return [RandomForestClassifier(labelCol="label_d", featuresCol="features", weightCol="weight",
                                       numTrees=p.num_trees, maxDepth=p.max_depth, seed=seed)]
    if p.learner != "boosted":
        raise ValueError(f"no such learner: {p.learner}")
    return [GBTClassifier(labelCol=f"is_{c}", featuresCol="features", weightCol="weight", maxIter=p.max_iter, maxDepth=p.max_depth,
                          stepSize=p.step_size, seed=seed, validationIndicatorCol="is_val", validationTol=p.validation_tol,
                          predictionCol=f"prediction_{c}").setProbabilityCol(f"probability_{c}").setRawPredictionCol(f"raw_{c}")
            for c in RISK_CLASSES]


def train_risk_cv(cv: DataFrame, folds: int = 5, label: str = "risk_level",
                  params: RiskParams | None = None, parallelism: int = 5) -> FoldEnsemble:
    """``cv`` carries model inputs, ``fold`` and the risk level.  The weights
    are balanced on each fold's training part; validation rows weigh as rows of their class."""
    p = params or RiskParams()
    data = _training_rows(cv.filter(F.col(label).isNotNull()).withColumns(
        {"label_d": F.col(label).cast("double"), **{f"is_{c}": (F.col(label) == c).cast("double") for c in RISK_CLASSES}}),
        label, "label_d", *IS_CLASS)
    training = {k: F.col("fold") != k for k in range(folds)}
    size, most = ROW_BYTES * data.count(), storage_bytes(cv.sparkSession)
    data = _encoded(data, training, "label_d", p.smoothing, p.seed)
    try:
        def fit_fold(k):
            held = data.filter(F.col("fold") == k)
            te, both = _fold_rows(data, training, k, "label_d", p.smoothing)
            weight = F.lit(1.0)
            for r in class_weights(data.filter(training[k]), label).collect():                       # a row per class
                weight = F.when(F.col(label) == r[label], r["weight"]).otherwise(weight)
            both = both.withColumn("weight", weight)
            learners = _risk_learners(p, p.seed + k)
            rows = both if p.learner == "boosted" else both.filter("not is_val")
            fitted = Pipeline(stages=[_plain_encodings(), _assembler(), *learners]).fit(rows)
            model = PipelineModel(stages=[te, *fitted.stages])
            scored = model.transform(held)
            best = _class_probabilities(scored)
            right = (F.array_position(best, F.array_max(best)) - 1) == F.col(label)
            acc = scored.agg(F.avg(right.cast("double"))).first()[0]
            return model, float(acc) if acc is not None else float("nan")

        out = _run_folds(in_room(fit_fold, size, most), folds, parallelism)
        return FoldEnsemble("risk", [m for m, _ in out], [sc for _, sc in out])
    finally:
        data.unpersist()


# ---------------------------------------------------------------- bundle
@dataclass
class Bundle:
    """Everything needed to score: text pipeline, indexer, fold models."""
    tfidf: object
    lsa: object
    indexer: StringIndexerModel
    effort: FoldEnsemble
    risk: FoldEnsemble | None
    run_id: str = ""

    def features(self, df: DataFrame, doc: str = "ticket_id", strip: bool = True) -> DataFrame:
        return featurize(df, self.tfidf, self.lsa, self.indexer, doc, strip)

    def score(self, df: DataFrame, doc: str = "ticket_id") -> DataFrame:
        return score_batch(df, self, doc)


def featurize(df: DataFrame, tfidf, lsa, indexer: StringIndexerModel, doc: str = "ticket_id",
              strip: bool = True) -> DataFrame:
    """Requests/tickets -> model inputs: text, the 7 features, LSA
    embedding, category indices.  Missing categories become 'Unknown'.  Each
    row is featurised by itself: ids may be missing or repeated."""
    d = T.fill_text(df) if "description" in df.columns else df.withColumn("description", F.lit(""))
    d = d.withColumn("text", T.concat_text("summary", "description", strip=strip))
    d = T.text_features(d, "text", "description")
    d = with_default_categories(d)
    return model_input(indexer.transform(TX.embed_texts(d, tfidf, lsa)))


def score_batch(df: DataFrame, bundle: Bundle, doc: str = "ticket_id") -> DataFrame:
    """Both ensembles and the formatted response columns for a whole table."""
    f = bundle.features(df, doc)
    e = bundle.effort.ensemble(f)
    if bundle.risk is not None:
        e = bundle.risk.ensemble(e)
    else:
        e = e.withColumns({"p_low": F.lit(1.0), "p_medium": F.lit(0.0), "p_critical": F.lit(0.0)})
    out = e.select(doc, "pred_log", "pred_days", "pred_std_days", "p_low", "p_medium", "p_critical",
                   *[v.alias(k) for k, v in L.format_prediction().items()])
    return out.withColumn("model_run_id", F.lit(bundle.run_id))


def save_bundle(bundle: Bundle, path: str) -> None:
    """Spark ML writers for models; vocabulary and basis as Parquet."""
    spark = bundle.tfidf.vocab.sparkSession
    bundle.tfidf.vocab.write.mode("overwrite").parquet(os.path.join(path, "vocab"))
    bundle.lsa.basis.write.mode("overwrite").parquet(os.path.join(path, "basis"))
    bundle.indexer.write().overwrite().save(os.path.join(path, "indexer"))
    models = [(f"{kind}_fold_{k}", m) for kind, ens in (("effort", bundle.effort), ("risk", bundle.risk)) if ens for k, m in enumerate(ens.models)]
    _run_folds(lambda i: models[i][1].write().overwrite().save(os.path.join(path, models[i][0])), len(models), IO_THREADS)
    meta = {"run_id": bundle.run_id, "n_docs": bundle.tfidf.n_docs, "size": bundle.tfidf.size,
            "singular_values": [float(x) for x in bundle.lsa.singular_values],
            "effort_scores": bundle.effort.scores, "effort_folds": len(bundle.effort.models),
            "risk_scores": bundle.risk.scores if bundle.risk else [],
            "risk_folds": len(bundle.risk.models) if bundle.risk else 0}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "meta"))


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    import numpy as np

    from .text import LsaModel, TfidfModel
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    vocab = spark.read.parquet(os.path.join(path, "vocab"))
    basis = spark.read.parquet(os.path.join(path, "basis"))
    rows = basis.orderBy("term_idx").collect()          # size x k, bounded by max_features
    V = np.array([r["comp"] for r in rows]) if rows else np.zeros((0, 0))
    tfidf = TfidfModel(vocab, meta["n_docs"], meta["size"])
    lsa = LsaModel(V, np.array(meta["singular_values"]), basis)
    indexer = StringIndexerModel.load(os.path.join(path, "indexer"))
    names = [f"{kind}_fold_{k}" for kind in ("effort", "risk") for k in range(meta[f"{kind}_folds"])]
    models = _run_folds(lambda i: PipelineModel.load(os.path.join(path, names[i])), len(names), IO_THREADS)
    effort = FoldEnsemble("effort", models[:meta["effort_folds"]], meta["effort_scores"])
    risk = FoldEnsemble("risk", models[meta["effort_folds"]:], meta["risk_scores"]) if meta["risk_folds"] else None
    return Bundle(tfidf, lsa, indexer, effort, risk, meta["run_id"])
