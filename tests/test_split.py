"""Split and fold properties; ranks equal the plain (single-task) window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from effortlab.operators import split as SP
from effortlab.plans.prepare import prepare_dataset
from effortlab.sources import tables as S
from tests.conftest import SF01


def ds(spark):
    return prepare_dataset(S.tickets(spark, SF01))


def test_split_disjoint_complete_share_preserving(spark):
    d = ds(spark)
    s = SP.stratified_split(d).cache()
    assert s.count() == d.count() == s.select("ticket_id").distinct().count()
    per = {(r.risk_level, r.split): r.n for r in s.groupBy("risk_level", "split").agg(F.count("*").alias("n")).collect()}
    for k in {c for c, _ in per}:
        n = sum(v for (c, _), v in per.items() if c == k)
        assert per[(k, "train")] == (8 * n) // 10
        assert per[(k, "train")] + per[(k, "test")] == (9 * n) // 10


def test_bucketed_rank_equals_plain_window(spark):
    d = ds(spark).select("ticket_id", "risk_level")
    fast = SP.exact_rank(d, "ticket_id", "42|", ["risk_level"]).select("ticket_id", "_rk")
    h = SP.salted_hash("ticket_id", "42|")
    plain = d.withColumn("rk", F.row_number().over(Window.partitionBy("risk_level").orderBy(h, "ticket_id")))
    diff = fast.join(plain, "ticket_id").filter(F.col("_rk") != F.col("rk")).count()
    assert diff == 0


def test_folds_balanced(spark):
    f = SP.kfold_assign(ds(spark))
    sizes = [r.n for r in f.groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_fold_bounds_equal_plain_percentiles(spark):
    import numpy as np
    f = SP.kfold_assign(ds(spark).select("ticket_id", "logged_days"))
    rows = [(r.fold, r.logged_days) for r in f.collect()]
    for r in SP.fold_bounds(f).collect():
        train = [y for k, y in rows if k != r.fold]
        assert np.allclose([r.lower, r.upper], np.percentile(train, [1, 99]))
    roles = SP.fold_roles(f).groupBy("cv_fold", "role").agg(F.count("*").alias("n"))
    val = {r.cv_fold: r.n for r in roles.collect() if r.role == "val"}
    assert sum(val.values()) == len(rows)


def test_no_row_is_lost(spark):
    rows = [(1, 0, "a"), (2, None, "b"), (3, 1, None), (4, None, "d"), (5, 0, "e"), (5, 0, "e2")]
    d = spark.createDataFrame(rows, "ticket_id int, risk_level int, x string")
    s = SP.stratified_split(d).collect()
    assert sorted((r.ticket_id, r.risk_level, r.x) for r in s if r.x) == sorted(r for r in rows if r[2]) and len(s) == 6
    assert len({r.split for r in s if r.ticket_id == 5}) == 1          # a repeated id has one label
    f = SP.kfold_assign(d, k=2).collect()
    assert len(f) == 6 and {r.fold for r in f} == {0, 1}


def test_a_null_id_stops_the_job(spark):
    d = spark.createDataFrame([(1, 0), (None, 1)], "ticket_id int, risk_level int")
    for op in (SP.stratified_split, SP.kfold_assign):
        with pytest.raises(Exception, match="ticket_id is null"):
            op(d).collect()
