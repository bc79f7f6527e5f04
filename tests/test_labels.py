"""Targets, labels and scalar formulas."""

import math

from pyspark.sql import functions as F

from effortlab.functions import labels as L
from effortlab.operators import aggregates as A
from effortlab.operators import ensemble as EN


def test_risk_level(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.5, 1.0), (1.51, 1.0)], "logged_days double, estimate double")
    assert [r.r for r in df.select(L.risk_level().alias("r")).collect()] == [0, 1, 2]


def test_workdays(spark):
    assert spark.range(1).select(L.to_workdays(F.lit(28800)).alias("d")).first().d == 1.0


def test_filter_valid(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 0.0), (1.0, 10.0), (1.0, 10.5), (None, 3.0)],
                               "logged_days double, estimate double")
    assert [r.estimate for r in L.filter_valid(df).collect()] == [10.0]


def test_delta_pct(spark):
    df = spark.createDataFrame([(1.5, 2.0), (3.0, 2.0), (1.0, 0.0)], "predicted_days double, actual_days double")
    got = [r.d for r in df.select(L.delta_pct().alias("d")).collect()]
    assert got == [25.0, -50.0, None]
    assert df.select(L.delta_pct_abs().alias("d")).first().d == 25.0
    assert df.select(L.delta_pct_abs().alias("d")).collect()[1].d == 50.0


def test_ensemble_effort_and_buffer(spark):
    df = spark.createDataFrame([tuple([0.5] * 5) + (0.6, 0.3, 0.1)],
                               "a double, b double, c double, d double, e double, p0 double, p1 double, p2 double")
    e = EN.ensemble_effort(df, list("abcde"))
    r = e.select("pred_days", "pred_std_days", L.risk_buffer_factor("p1", "p2").alias("f")).first()
    assert math.isclose(r.pred_days, math.expm1(0.5)) and r.pred_std_days == 0.0
    assert math.isclose(r.f, 1.095)


def test_ensemble_risk_ties_lowest_index(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.1, 0.2, 0.7)], "a double, b double, c double")
    out = EN.ensemble_risk(df, [["a", "b", "c"]])
    assert [r.pred_risk for r in out.collect()] == [0, 1, 2]


def test_validate_summary(spark):
    df = spark.createDataFrame([("   ",), ("ok",), (None,)], "summary string")
    ok, bad = L.split_valid(df)
    assert ok.count() == 1 and bad.count() == 2


def test_feedback_counts_and_hours(spark):
    df = spark.createDataFrame([(0,)] * 12, "is_used_for_training int")
    r = A.feedback_counts(df, 50).first()
    assert (r.unused, r.retrain_ready, r.remaining) == (12, False, 38)
    assert spark.range(1).select(L.hours_saved(F.lit(12)).alias("h")).first().h == 3.0


def test_fold_scores_json_roundtrip(spark):
    df = spark.createDataFrame([([0.168, 0.162],), (None,)], "fold_scores array<double>")
    js = df.select(L.fold_scores_to_json().alias("j"))
    back = [r.b for r in js.select(L.fold_scores_from_json("j").alias("b")).collect()]
    assert back == [[0.168, 0.162], []]
    empty = spark.createDataFrame([("",), (None,)], "j string").select(L.fold_scores_from_json("j").alias("b"))
    assert [r.b for r in empty.collect()] == [[], []]


def test_format_prediction_rounding(spark):
    df = spark.createDataFrame([(1.0, 0.123, 0.6, 0.3, 0.1)],
                               "pred_days double, pred_std_days double, p_low double, p_medium double, p_critical double")
    r = df.select(*[v.alias(k) for k, v in L.format_prediction().items()]).first()
    assert r.predicted_time_hours == 8.0 and r.adjusted_time_with_buffer_hours == 8.8
    assert r.prediction_std_days == 0.12
    assert (r.risk_profile.low_risk_prob_pct, r.risk_profile.critical_risk_prob_pct) == (60.0, 10.0)
