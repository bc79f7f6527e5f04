"""Model learning check on a planted signal, explanations, persistence and
streaming = batch."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from effortlab.operators import aggregates as A
from effortlab.operators import explain as XP
from effortlab.operators import models as MD
from effortlab.operators import text as TX
from effortlab.plans import reports as R
from effortlab.plans.prepare import prepare_dataset
from effortlab.plans.train import train_all
from effortlab.sources import store as ST
from effortlab.sources import tables as S
from effortlab.streaming import jobs as SJ
from tests.conftest import SF01


def planted(spark):
    """Effort depends on one word in the summary and one region, plus fixed noise."""
    t = S.tickets(spark, SF01)
    word = (F.col("ticket_id") % 3 == 0)
    days = (0.5 + F.when(word, 3.0).otherwise(0.0) + F.when(F.col("region") == "ASIA", 2.0).otherwise(0.0)
            + (F.col("ticket_id") % 7) / 10.0)
    t = t.withColumns({
        "summary": F.when(word, F.concat(F.col("summary"), F.lit(" migration"))).otherwise(F.col("summary")),
        "time_spent": F.floor(days * 28800).cast("bigint"),
        "estimate": F.lit(3.0),
    })
    return prepare_dataset(t)


@pytest.fixture(scope="module")
def trained(spark):
    return train_all(planted(spark), k=8, effort_params=MD.EffortParams(max_iter=15),
                     risk_params=MD.RiskParams(max_iter=6, max_depth=4))


def test_effort_model_beats_global_median(spark, trained):
    test = trained.features.filter(F.col("split") == "test")
    model = trained.bundle.effort.ensemble(test).select("ticket_id", "pred_log")
    train = trained.splits.filter(F.col("split") == "train")
    tst = trained.splits.filter(F.col("split") == "test").join(model, "ticket_id")
    rep = {r.baseline: r for r in R.baseline_report(train, tst, model_pred_log="pred_log", decimals=False).collect()}
    assert rep["Model ensemble"].r2_days > rep["Global median"].r2_days + 0.3
    assert rep["Model ensemble"].mae_days < rep["Global median"].mae_days
    assert len(trained.bundle.effort.scores) == 5


def test_risk_probabilities_sum_to_one(spark, trained):
    test = trained.features.filter(F.col("split") == "test")
    r = trained.bundle.risk.ensemble(test)
    bad = r.filter(F.abs(F.col("p_low") + F.col("p_medium") + F.col("p_critical") - 1.0) > 1e-9).count()
    assert bad == 0 and r.filter(~F.col("pred_risk").isin(0, 1, 2)).count() == 0


def planted_risk(spark, n=900):
    """Critical tickets are few and told by one number; the middle class by another."""
    import random
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b = rng.random(), rng.random()
        level = 2 if a > 0.9 else 1 if b > 0.75 else 0
        if rng.random() < 0.05:
            level = rng.randrange(3)
        rows.append((i, i % 3, level, [a, b], f"s{rng.randrange(5)}"))
    df = spark.createDataFrame(rows, "ticket_id bigint, fold int, risk_level int, embedding array<double>, subsystem string")
    df = df.selectExpr("*", "'r' as region", "'c' as commitments", *[f"0 as {c}" for c in MD.NUMS])
    return MD.model_input(MD.category_indexer(df).transform(MD.with_default_categories(df)))


def test_boosted_risk_stops_early_and_beats_the_forest(spark):
    cv = planted_risk(spark)
    boosted = MD.train_risk_cv(cv, 3, params=MD.RiskParams(max_iter=25, max_depth=3, validation_tol=0.01))
    forest = MD.train_risk_cv(cv, 3, params=MD.RiskParams(learner="forest", num_trees=10, max_depth=3))
    trees = [m.getNumTrees for fold in boosted.models for m in fold.stages if hasattr(m, "getNumTrees")]
    assert len(trees) == 9 and min(trees) < 25                 # a learner per class and fold; early stop seen
    assert sum(boosted.scores) >= sum(forest.scores) and min(boosted.scores) > 0.75
    probs = boosted.ensemble(cv).select("p_low", "p_medium", "p_critical").collect()
    assert all(abs(sum(r) - 1) < 1e-9 and min(r) > 0 for r in probs)
    with pytest.raises(ValueError):
        MD.train_risk_cv(cv, 3, params=MD.RiskParams(learner="none"))


def test_risk_weights_are_balanced_in_each_fold(spark, monkeypatch):
    """Weighted sums of the classes are equal in the training part of every fold."""
    seen = []
    fit = MD.Pipeline.fit

    def spy(self, df, *more):
        seen.append(df.filter("not is_val").groupBy("risk_level").agg(F.sum("weight")).collect())
        return fit(self, df, *more)

    monkeypatch.setattr(MD.Pipeline, "fit", spy)
    MD.train_risk_cv(planted_risk(spark, 200), 3, params=MD.RiskParams(max_iter=1, max_depth=1), parallelism=1)
    assert len(seen) == 3
    for rows in seen:
        sums = [r[1] for r in rows]
        assert len(sums) == 3 and max(sums) == pytest.approx(min(sums))


def test_embeddings_are_local_to_rows(spark, trained):
    """No shuffle above the rows' own, and the numbers of the relational way."""
    b = trained.bundle
    texts = ["T-1 migration of the customer", "", None, "Customer#000000001 customer migration T-1 " * 50, "unknown zzzz words", "T-1 migration of the customer"]
    df = spark.createDataFrame(list(enumerate(texts)), "ticket_id bigint, text string")
    got = {r.ticket_id: r.embedding for r in TX.embed_texts(df, b.tfidf, b.lsa).collect()}
    want = {r.ticket_id: r.embedding for r in b.lsa.transform(b.tfidf.transform(df), docs=df).collect()}
    assert all(x == pytest.approx(y, abs=1e-9) for i in want for x, y in zip(got[i], want[i], strict=True)) and len(got) == len(want) == 6
    assert any(got[0]) and not any(got[1]) and not any(got[2]) and got[0] == got[5]
    every = S.tickets(spark, SF01)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    exchanges = lambda d: plan(d).count("Exchange hashpartitioning") + plan(d).count("Exchange range")
    assert exchanges(b.score(every)) == exchanges(every)
    assert exchanges(XP.explain(b.features(every), b)) == exchanges(every)


def test_embedding_in_parts_changes_nothing(monkeypatch):
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(3)
    terms, idf, basis = [f"t{i}" for i in range(30)], rng.uniform(1, 5, 30), rng.normal(size=(30, 4))
    lists = [[f"t{rng.integers(40)}" for _ in range(rng.integers(0, 60))] for _ in range(50)] + [None, []]
    args = pa.array(lists, pa.list_(pa.string())), pa.array(terms), idf, basis
    want = []
    for words in lists:
        e, norm = np.zeros(4), 0.0
        for t in range(30):
            tf = (words or []).count(f"t{t}")
            if tf:
                w = (1 + np.log(tf)) * idf[t]
                e, norm = e + w * basis[t], norm + w * w
        want.append((e / np.sqrt(norm) if norm else e).tolist())
    for rows in (256, 1, 7):
        monkeypatch.setattr(TX, "EMBED_ROWS", rows)
        assert np.allclose(TX.embed_token_lists(*args).to_pylist(), want, atol=1e-12)
    assert len(TX.embed_token_lists(pa.array([], pa.list_(pa.string())), *args[1:])) == 0


def test_explanations_add_up(spark, trained):
    test = trained.features.filter(F.col("split") == "test")
    ex = XP.explain(test, trained.bundle)
    m0 = trained.bundle.effort.models[0].transform(test).select("ticket_id", F.col("prediction").alias("p0"))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    err = ex.join(m0, "ticket_id").agg(F.max(F.abs(F.col("base_log") + total - F.col("p0")))).first()[0]
    assert err < 1e-9
    top = ex.select("top_features").first()[0]
    assert len(top) == 10 and all(abs(top[i].shap_value) >= abs(top[i + 1].shap_value) for i in range(9))


def test_tree_shap_equals_shapley_by_definition():
    from itertools import combinations

    import numpy as np
    rng = np.random.default_rng(4)
    # Depth 3; feature 1 is tested twice on one path, 3 nowhere.
    tab = {"feature": np.array([0, 1, 2, 1, 0, -1, -1] + [-1] * 6), "root": 0, "weight": 0.5,
           "left": np.array([1, 3, 5, 7, 9, -1, -1] + [-1] * 6), "right": np.array([2, 4, 6, 8, 10, -1, -1] + [-1] * 6),
           "threshold": np.array([0.0, 0.5, -0.2, -0.5, 1.0, 0, 0] + [0.0] * 6), "value": rng.normal(size=13)}
    cover = np.zeros(13)
    cover[[5, 6, 7, 8, 9, 10]] = [3, 9, 2, 6, 4, 5]
    for j in (4, 3, 2, 1, 0):
        cover[j] = cover[tab["left"][j]] + cover[tab["right"][j]]
    tab["cover"] = cover

    def expected(x, known, j=0):
        if tab["left"][j] < 0:
            return tab["value"][j]
        a, b = tab["left"][j], tab["right"][j]
        if tab["feature"][j] in known:
            return expected(x, known, a if x[tab["feature"][j]] <= tab["threshold"][j] else b)
        return (cover[a] * expected(x, known, a) + cover[b] * expected(x, known, b)) / cover[j]

    x = rng.normal(size=(200, 4))
    phi = np.zeros((200, 4))
    XP.tree_shap(tab, XP.leaf_tables(tab), x, phi)
    for row, got in zip(x, phi, strict=True):
        for f in range(4):
            rest = [i for i in range(4) if i != f]
            want = sum(math.factorial(n) * math.factorial(3 - n) / math.factorial(4) * (expected(row, {*c, f}) - expected(row, set(c)))
                       for n in range(4) for c in combinations(rest, n))
            assert abs(got[f] - 0.5 * want) < 1e-12


def test_rows_are_scored_by_themselves(spark, trained):
    rows = [(7, "T-1 migration", "ASIA"), (7, "T-2 other", "EUROPE"), (None, "T-1 migration", "ASIA"), (8, None, None)]
    df = spark.createDataFrame([(*r, "", "s", "c") for r in rows],
                               "ticket_id bigint, summary string, region string, description string, subsystem string, commitments string")
    got = sorted((str(r.ticket_id), r.pred_days) for r in trained.bundle.score(df).collect())
    alone = sorted((str(r.ticket_id), r.pred_days) for k in range(4)
                   for r in trained.bundle.score(spark.createDataFrame([df.collect()[k]], df.schema)).collect())
    assert len(got) == 4 and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(got, alone, strict=True))
    assert XP.explain(trained.bundle.features(df), trained.bundle).count() == 4


def test_missing_category_is_no_unseen_one(spark):
    d = spark.createDataFrame([("a", "x", "p"), ("", None, "p"), (None, "x", "q")], "region string, subsystem string, commitments string")
    model = MD.category_indexer(d)
    got = model.transform(MD.with_default_categories(spark.createDataFrame(
        [(1, "a"), (2, ""), (3, None), (4, "never")], "id int, region string"))).collect()
    idx = {r.id: r.region_idx for r in got}
    assert idx[2] == idx[3] != idx[4] and idx[4] == 2.0 and idx[1] != idx[2]


def test_save_load_same_predictions(spark, trained, tmp_dir):
    path = os.path.join(tmp_dir, "bundle")
    MD.save_bundle(trained.bundle, path)
    loaded = MD.load_bundle(spark, path)
    test = S.tickets(spark, SF01).join(trained.splits.filter("split = 'test'").select("ticket_id"), "ticket_id")
    a = trained.bundle.score(test).select("ticket_id", F.col("pred_days").alias("a"), F.col("p_critical").alias("pa"))
    b = loaded.score(test).select("ticket_id", F.col("pred_days").alias("b"), F.col("p_critical").alias("pb"))
    j = a.join(b, "ticket_id")
    assert j.count() == test.count()
    assert j.filter((F.abs(F.col("a") - F.col("b")) > 1e-9) | (F.abs(F.col("pa") - F.col("pb")) > 1e-9)).count() == 0


def test_score_stream_equals_batch_and_replay(spark, trained, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ckpt"))
    reqs = S.tickets(spark, SF01).join(trained.splits.filter("split = 'test'").select("ticket_id"), "ticket_id") \
        .select(*SJ.REQUEST_SCHEMA.fieldNames())
    reqs.repartition(3).write.parquet(src)
    SJ.score_stream(spark, src, trained.bundle, sink, ckpt, max_files_per_trigger=1).awaitTermination()
    SJ.score_stream(spark, src, trained.bundle, sink, ckpt).awaitTermination()     # restart: nothing new
    stream = spark.read.parquet(sink).select("ticket_id", F.col("pred_days").alias("s"))
    batch = trained.bundle.score(reqs).select("ticket_id", F.col("pred_days").alias("b"))
    assert stream.count() == reqs.count()
    assert stream.join(batch, "ticket_id").filter(F.abs(F.col("s") - F.col("b")) > 1e-9).count() == 0


def test_feedback_stream_counts(spark, tmp_dir):
    """After every batch the totals equal the batch operator's, over replays and marks."""
    src, fb, ckpt, totals, marks = (os.path.join(tmp_dir, x) for x in ("src", "fb", "ckpt", "totals", "marks"))
    rows = [(i, f"Task {i}" if i % 10 else "  ", "", "r", "s", "c", 1.0, 2.0 if i % 7 else None) for i in range(60)]

    def arrive(part, name):
        spark.createDataFrame(part, SJ.FEEDBACK_REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        SJ.feedback_stream(spark, src, fb, ckpt, marks_path=marks, totals_path=totals, threshold=20).awaitTermination()
        return spark.read.parquet(totals).orderBy(F.col("batch_id").desc()).drop("batch_id").first()

    for k in range(3):
        last = arrive(rows[k * 20:k * 20 + 20], k)
        state = ST.read_feedback(spark, fb, marks)
        assert last == A.feedback_counts(state, 20).first() == ST.feedback_totals(spark, fb, marks, 20).first()
        if k == 1:
            ids = state.limit(15).select("id")
            for run in ("a", "a", "b"):                      # the same marks again, by the run and by another
                ST.mark_used(ids, marks, run)
            assert ST.feedback_totals(spark, fb, marks, 20).first().unused == last.total - 15
    before = ST.feedback_totals(spark, fb, marks, 20).first()
    ST.append_feedback(spark.createDataFrame(rows[40:], SJ.FEEDBACK_REQUEST_SCHEMA), fb, 2)                 # a replayed batch
    assert ST.feedback_totals(spark, fb, marks, 20).first() == before
    ST.append_feedback(spark.createDataFrame(rows[:1], SJ.FEEDBACK_REQUEST_SCHEMA), fb, 2)                  # that has no valid row now
    after = ST.feedback_totals(spark, fb, marks, 20).first()
    assert after.total == ST.read_feedback(spark, fb).count() < before.total


def test_two_triggers_retrain_once(spark, tmp_dir):
    """Two drivers on one store: both see enough feedback at once, one retrains."""
    import threading
    fb, marks = os.path.join(tmp_dir, "fb"), os.path.join(tmp_dir, "marks")
    rows = [(i, f"Task {i}", "", "r", "s", "c", 1.0, 2.0) for i in range(60)]
    ST.append_feedback(spark.createDataFrame(rows, SJ.FEEDBACK_REQUEST_SCHEMA), fb, 0)
    together, runs = threading.Barrier(2), []

    def retrain():
        runs.append(1)
        ST.mark_used(ST.unused_rows(ST.read_feedback(spark, fb, marks)), marks, "run")

    class Both(SJ.RetrainTrigger):
        def _ready(self):
            ready = super()._ready()
            if together.n_waiting < 2 and not getattr(self, "met", False):
                self.met = True
                together.wait(60)
            return ready

    both = [Both(spark, retrain, fb, marks) for _ in range(2)]
    threads = [threading.Thread(target=t.check) for t in both]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(runs) == 1 and sum(len(t.results) for t in both) == 1
    SJ.RetrainTrigger(spark, retrain, fb, marks).check()                                  # nothing unused is left
    assert len(runs) == 1


def test_lease_is_exclusive_renewed_and_taken_over(spark, tmp_dir):
    import time

    from effortlab.streaming.lease import Lease
    folder = os.path.join(tmp_dir, "lease")
    a, b = Lease(spark, folder, ttl=2.0), Lease(spark, folder, ttl=2.0)
    assert a.acquire() and not b.acquire()
    time.sleep(3)                                            # renewed meanwhile
    assert not b.acquire()
    a.release()
    assert b.acquire() and not a.acquire()
    b._stop.set()                                            # its driver is gone
    time.sleep(2.5)
    assert a.acquire() and not Lease(spark, folder, ttl=2.0).acquire()
    b.release()                                              # too late: it says nothing about the new holder
    assert not Lease(spark, folder, ttl=2.0).acquire()
    a.release()


def test_identical_requests_are_numbered_in_runs(spark, tmp_dir, monkeypatch):
    """One request as most of a batch: unique ids that a replay repeats, written by several tasks."""
    monkeypatch.setattr(ST, "RUN", 50)
    rows = [("same", 1.0, 2.0)] * 900 + [(f"t{i}", 1.0, 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "summary string, predicted_days double, actual_days double")
    got = ST.feedback_rows(df, 3)
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) == 920
    assert {r.id for r in ST.feedback_rows(df.repartition(7), 3).collect()} == set(ids)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # it would join these few rows again
    try:
        spread = got.filter("summary = 'same'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spread) > 2 and max(r["count"] for r in spread) < 900


def test_score_response_columns(spark, trained):
    reqs = spark.createDataFrame([(1, "Implement login", "", None, None, None)],
                                 "ticket_id long, summary string, description string, region string, "
                                 "subsystem string, commitments string")
    r = trained.bundle.score(reqs).first()
    assert r.predicted_time_hours >= 0 and r.adjusted_time_with_buffer_hours >= r.predicted_time_hours
    p = r.risk_profile
    assert abs(p.low_risk_prob_pct + p.medium_risk_prob_pct + p.critical_risk_prob_pct - 100.0) < 0.2
    assert r.model_run_id == trained.bundle.run_id


def test_blank_summary_rejected_by_stream(spark, trained, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ckpt"))
    rows = [(1, "   ", "", "r", "s", "c"), (2, "Fix bug", "", "r", "s", "c")]
    spark.createDataFrame(rows, SJ.REQUEST_SCHEMA).write.parquet(src)
    SJ.score_stream(spark, src, trained.bundle, sink, ckpt).awaitTermination()
    assert [r.ticket_id for r in spark.read.parquet(sink).collect()] == [2]
    assert [r.ticket_id for r in spark.read.parquet(sink + "_rejected").collect()] == [1]


def test_retrain_threshold_skip_and_dry_run(spark, tmp_dir):
    from effortlab.plans import jobs as JB
    fb, marks, runs = (os.path.join(tmp_dir, x) for x in ("fb", "marks", "runs"))
    rows = [(f"Task {i}", "", "r", "s", "c", 1.0, 2.0) for i in range(12)]
    ST.append_feedback(spark.createDataFrame(rows, "summary string, description string, region string, "
                                                   "subsystem string, commitments string, predicted_days double, "
                                                   "actual_days double"), fb, 0)
    res = JB.retrain_job(spark, None, None, fb, marks, runs)
    assert (res.status, res.unused) == ("skipped", 12)
    res = JB.retrain_job(spark, None, None, fb, marks, runs, threshold=10, dry_run=True)
    assert res.status == "would_retrain"


def test_learners_read_rows_that_are_written_once(spark, monkeypatch):
    plans, fit = [], MD.Pipeline.fit

    def spy(self, rows, *args):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return fit(self, rows, *args)

    monkeypatch.setattr(MD.Pipeline, "fit", spy)
    MD.train_risk_cv(planted_risk(spark, 200), 3, params=MD.RiskParams(max_iter=1, max_depth=1), parallelism=1)
    assert len(plans) == 3 and not any(step in p for p in plans for step in ("Window", "Join", "Aggregate"))


def test_fold_models_are_saved_and_loaded_side_by_side(spark, tmp_path, monkeypatch):
    """Models wait for each other, so one at a time would never end; they come back in order."""
    import threading
    meet = threading.Barrier(4, timeout=30)

    class Model:
        def __init__(self, name):
            self.name = name

        def write(self):
            return self

        def overwrite(self):
            return self

        def save(self, path):
            meet.wait()
            (tmp_path / path.rsplit("/", 1)[1]).write_text(self.name)

    class Loader:
        @staticmethod
        def load(path):
            meet.wait()
            return (tmp_path / path.rsplit("/", 1)[1]).read_text()

    class Indexer(Model):
        def save(self, path):
            pass

    vocab = spark.createDataFrame([("a", 0, 1.0)], "term string, term_idx int, idf double")
    basis = spark.createDataFrame([(0, [1.0])], "term_idx int, comp array<double>")
    bundle = MD.Bundle(TX.TfidfModel(vocab, 1, 1), TX.LsaModel(np.ones((1, 1)), np.ones(1), basis), Indexer(""),
                       MD.FoldEnsemble("effort", [Model("e0"), Model("e1")], [0.1, 0.2]), MD.FoldEnsemble("risk", [Model("r0"), Model("r1")], [0.3, 0.4]), "run")
    MD.save_bundle(bundle, str(tmp_path / "b"))
    monkeypatch.setattr(MD, "PipelineModel", Loader)
    monkeypatch.setattr(MD.StringIndexerModel, "load", lambda path: None)
    back = MD.load_bundle(spark, str(tmp_path / "b"))
    assert (back.effort.models, back.risk.models, back.run_id) == (["e0", "e1"], ["r0", "r1"], "run")


def test_effort_and_risk_are_trained_side_by_side(spark, monkeypatch):
    """Either waits for the other to begin, so one after the other would never end; each gets its own result."""
    import threading
    from effortlab.plans import train as TR
    meet = threading.Barrier(2, timeout=60)

    def trainer(kind):
        def run(cv, folds, params=None):
            assert {"fold", "emb_vec"} <= set(cv.columns)
            meet.wait()
            return MD.FoldEnsemble(kind, [])
        return run

    for kind in ("effort", "risk"):
        monkeypatch.setattr(MD, f"train_{kind}_cv", trainer(kind))
    bundle = TR.train_all(prepare_dataset(S.tickets(spark, SF01)), k=4).bundle
    assert (bundle.effort.kind, bundle.risk.kind) == ("effort", "risk")
