"""Boosted fold models scored as arrays, against their stages."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from effortlab.operators import models as MD
from effortlab.operators import scoring as SC


@pytest.fixture(scope="module")
def cv(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        region, emb = rng.choice("ABCD"), [rng.gauss(0, 1) if i % 9 else 0.0 for _ in range(4)]
        signal = "ABCD".index(region) + emb[0] * 2 + rng.gauss(0, 0.3)
        rows.append((i, i % 2, region, region + rng.choice("xyz"), None if i % 13 == 0 else "c", emb, i % 5, 1.0 + abs(signal),
                     0 if signal < 1 else 1 if signal < 2.5 else 2))
    df = spark.createDataFrame(rows, "ticket_id long, has_description int, region string, subsystem string, commitments string, "
                                     "embedding array<double>, fold int, logged_days double, risk_level int")
    df = df.withColumns({c: F.lit(0) for c in MD.NUMS if c != "has_description"})
    return MD.model_input(MD.category_indexer(df).transform(MD.with_default_categories(df))).localCheckpoint()


@pytest.fixture(scope="module")
def ensembles(cv):
    return (MD.train_effort_cv(cv, 5, params=MD.EffortParams(max_iter=4, max_depth=4)),
            MD.train_risk_cv(cv, 5, params=MD.RiskParams(max_iter=4, max_depth=3)))


def strange(cv):
    """Indices that are new or missing."""
    return cv.withColumns({"region_idx": F.when(F.col("ticket_id") % 3 == 0, 77.0).otherwise(F.col("region_idx")),
                           "subsystem_idx": F.when(F.col("ticket_id") % 4 == 0, None).otherwise(F.col("subsystem_idx"))})


def test_arrays_score_as_the_stages_do(cv, ensembles):
    effort, risk = ensembles
    assert effort.transform(cv.limit(0)).collect() == []
    for rows in (cv, strange(cv)):
        out = effort.transform(rows)
        assert "UDF(struct(emb_vec" not in out._jdf.queryExecution().optimizedPlan().toString()     # no assembler a fold
        assert out.columns == [*rows.columns, *[f"pred_log_{k}" for k in range(5)]]
        want = {r["ticket_id"]: r for r in effort._transform_stages(rows).collect()}
        got = out.collect()
        assert len(got) == len(want)
        assert all(abs(r[f"pred_log_{k}"] - want[r["ticket_id"]][f"pred_log_{k}"]) < 1e-12 for r in got for k in range(5))
        want = {r["ticket_id"]: r for r in risk._transform_stages(rows, "p").collect()}
        got = risk.transform(rows, "p").collect()
        assert len(got) == len(want)
        assert all(abs(a - b) < 1e-12 for r in got for k in range(5) for a, b in zip(r[f"p_{k}"], want[r["ticket_id"]][f"p_{k}"], strict=True))


def test_scoring_starts_no_job(cv, ensembles):
    """A stage that assembles vectors looks at a first row, for which all that is shuffled before is shuffled."""
    sc = cv.sparkSession.sparkContext
    ensembles[0].transform(cv), ensembles[1].transform(cv)                # reads the models
    group = "scoring starts no job"
    sc.setJobGroup(group, group)
    try:
        ensembles[1].ensemble(ensembles[0].ensemble(cv))
        assert not sc.statusTracker().getJobIdsForGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_numbers_stop_the_job_as_in_the_stages(cv, ensembles, bad):
    rows = cv.withColumn("word_count", F.when(F.col("ticket_id") == 3, F.lit(bad).cast("double")).otherwise(F.col("word_count")))
    for scored in (ensembles[0].transform(rows), ensembles[0]._transform_stages(rows)):
        with pytest.raises(Exception, match="(?i)null|nan"):
            scored.agg(F.sum("pred_log_0")).collect()


def test_other_learners_keep_their_stages(cv):
    forest = MD.train_risk_cv(cv, 2, params=MD.RiskParams(learner="forest", num_trees=2, max_depth=2))
    assert SC.fold_arrays(forest.models, MD.NUMS, MD.IDX, MD.TE_NUM, cv.sparkSession) is None
    assert forest.ensemble(cv).filter("abs(p_low + p_medium + p_critical - 1) > 1e-9").count() == 0


def test_trees_of_uneven_depth_and_other_splits():
    text = """GBT: x
      Tree 0 (weight 1.0):
        If (feature 2 <= 0.5)
         Predict: 1.0E-3
        Else (feature 2 > 0.5)
         If (feature 0 <= -2.0)
          Predict: -4.0
         Else (feature 0 > -2.0)
          Predict: 8.0
      Tree 1 (weight 0.5):
        Predict: 3.0
    """
    import numpy as np
    trees = SC.read_trees(text, [1.0, 0.5])
    x = np.array([[9.0, 0.0, 0.5], [-2.0, 0.0, 0.6], [-1.9, 0.0, 0.6], [0.0, 0.0, np.nan]])
    assert SC.margins(trees, x).tolist() == [1.501, -2.5, 9.5, 9.5]
    assert SC.read_trees(text.replace("<= -2.0", "in {1.0}"), [1.0, 0.5]) is None
    assert SC.read_trees(text, [1.0]) is None


def test_learners_at_a_time_fit_in_memory(cv, monkeypatch):
    """Folds run side by side only as far as the executors can keep their rows; the models are the same."""
    import threading
    seen, taken, lock = [], [], threading.Lock()
    inner = MD.Room.take

    @contextmanager
    def take(self, size, most):
        with inner(self, size, most):
            with lock:
                seen.append(len(taken) + 1)
                taken.append(size)
            try:
                yield
            finally:
                with lock:
                    taken.pop()

    monkeypatch.setattr(MD.Room, "take", take)
    params = MD.EffortParams(max_iter=1, max_depth=2)
    many = MD.train_effort_cv(cv, 3, params=params)
    assert len(seen) == 3 and max(seen) > 1 and MD.ROOM.held == 0
    seen.clear()
    monkeypatch.setattr(MD, "ROW_BYTES", 1 << 50)
    one = MD.train_effort_cv(cv, 3, params=params)
    assert seen == [1, 1, 1] and MD.ROOM.held == 0 and many.scores == one.scores


def test_room_is_given_back_when_a_learner_fails(spark):
    room = MD.Room()
    with pytest.raises(ValueError):
        with room.take(5, 3):
            raise ValueError
    assert room.held == 0 and MD.storage_bytes(spark) > 1 << 20
