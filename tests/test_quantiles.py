"""The distributed median equals ``percentile``, whatever the values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effortlab.operators import metrics as M
from effortlab.operators import split as SP
from effortlab.operators.quantiles import exact_median, leave_one_out_quantiles

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [1.0, 2.0, INF, INF, NAN], [INF, INF, 1.0, None], [-INF, 0.0, -0.0, 5.0],
    [NAN, NAN, 1.0, 2.0], [0.25] * 50 + [1.0] * 49, []])
def test_equals_percentile(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_median(df, F.col("x")).first()[0]
    want = df.agg(F.percentile("x", 0.5)).first()[0]
    assert got == want or got is not None and math.isnan(got) and math.isnan(want)


def test_many_values_over_many_partitions(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=30_000), np.full(5_000, 0.25), rng.exponential(size=5_001)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(8)
    assert exact_median(df, F.col("x")).first()[0] == np.median(vals)


def test_metrics_use_it(spark):
    rng = np.random.default_rng(3)
    y, p = rng.exponential(size=(2, 4000))
    y[:5] = 0
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), strict=True)), "y double, p double")
    assert np.isclose(M.error_distribution(df).first().median_abs_error, np.median(np.abs(y - p)))
    k = y != 0
    assert np.isclose(M.mdape(df).first().mdape, np.median(np.abs(y - p)[k] / y[k] * 100))
    assert np.isclose(M.evaluate_effort(df).first().median_abs_error, np.median(np.abs(y - p)))


def test_leave_one_out_quantiles_equal_percentile(spark):
    """Continuous values, infinite ones and NaN, ties, rows without fold or value; a fold that is alone."""
    rng = np.random.default_rng(9)
    rows = [(float(v), int(f)) for v, f in zip(rng.normal(size=3000), rng.integers(0, 4, 3000))]
    rows += [(0.5, 0)] * 300 + [(INF, 1), (-INF, 2), (NAN, 3), (None, 0), (1.0, None), (-0.0, 1), (0.0, 2)]
    df = spark.createDataFrame(rows, "y double, fold int").repartition(5)
    shares = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    got = {r.fold: r.q for r in leave_one_out_quantiles(df, "y", "fold", 4, shares).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, q in got.items():
        want = df.filter(F.col("fold") != k).agg(F.percentile("y", shares)).first()[0]
        assert all(a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-12) for a, b in zip(q, want, strict=True))
    alone = spark.createDataFrame([(1.0, 0), (2.0, 0)], "y double, fold int")
    assert [r.fold for r in leave_one_out_quantiles(alone, "y", "fold", 2, [0.5]).collect()] == [1]
    plan = SP.fold_bounds(df, 4, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
