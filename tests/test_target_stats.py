"""Ordered target statistics: equal to running along the order; a row's own target never counts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from effortlab.operators import models as MD
from effortlab.operators.target_stats import ordered_target_stats

SCHEMA = "k bigint, a string, b int, y double, A_ENC double"


def plain(rows, order, column, smoothing):
    known = [r[3] for r in rows if r[3] is not None]
    prior = sum(known) / len(known) if known else 0.0
    total, count, out = {}, {}, {}
    for r in sorted(rows, key=lambda r: order[r[0]]):
        c = r[column]
        s, n = total.get(c, 0.0), count.get(c, 0)
        out[r[0]] = (s + smoothing * prior) / (n + smoothing) if n + smoothing else prior
        if r[3] is not None:
            total[c], count[c] = s + r[3], n + 1
    return out


@pytest.mark.parametrize("ranges", [1, 4, 4096])
@pytest.mark.parametrize("smoothing", [0.0, 10.0])
def test_equals_running_along_the_order(spark, ranges, smoothing):
    rng = random.Random(ranges)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice(["u", "v", None, ""]), rng.choice([1, 2, None]),
             None if rng.random() < 0.1 else rng.uniform(-5, 5), 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    hashed = {r.k: (r.h, r.k) for r in df.select("k", F.xxhash64(F.lit(42), "k").alias("h")).collect()}
    got = ordered_target_stats(df, {"a": "a_enc", "b": "b_enc"}, "y", "k", smoothing=smoothing, ranges=ranges)
    assert sorted(got.columns) == ["a", "a_enc", "b", "b_enc", "k", "y"]
    found = got.collect()
    want = plain(rows, hashed, 1, smoothing), plain(rows, hashed, 2, smoothing)
    assert len(found) == 400
    for r in found:
        assert r.a_enc == pytest.approx(want[0][r.k], abs=1e-9) and r.b_enc == pytest.approx(want[1][r.k], abs=1e-9)
    assert ordered_target_stats(df.limit(0), {"a": "a_enc"}, "y", "k").count() == 0


def test_a_category_of_one_row_carries_no_signal(spark):
    """Every row its own category: all get the prior, though the full mean would give their target away."""
    df = spark.range(500).selectExpr("id as k", "concat('c', id) as a", "cast(id % 17 as double) as y")
    got = ordered_target_stats(df, {"a": "e"}, "y", "k", smoothing=0.5)
    assert got.select("e").distinct().count() == 1
    both = df.select("k", "y", F.avg("y").over(Window.partitionBy("a")).alias("own")).filter("own = y")
    assert both.count() == 500


def test_a_rows_own_target_does_not_count(spark):
    """Changing a target changes no statistic of its own row but through the prior."""
    rows = [(i, f"c{i % 3}", float(i)) for i in range(60)]
    one = spark.createDataFrame(rows, "k bigint, a string, y double")
    two = one.withColumn("y", F.when(F.col("k") == 7, 1000.0).when(F.col("k") == 8, 8.0 + 7.0 - 1000.0).otherwise(F.col("y")))
    get = lambda d: {r.k: r.e for r in ordered_target_stats(d, {"a": "e"}, "y", "k").collect()}
    assert get(one)[7] == pytest.approx(get(two)[7]) and get(one) != get(two)


def test_folds_learn_nothing_from_their_own_categories(spark):
    """A subsystem per ticket and a target that nothing explains: the trees of a fold find no signal in it."""
    rng = random.Random(4)
    rows = [(i, rng.uniform(0.5, 8.0), f"s{i}", i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "ticket_id bigint, logged_days double, subsystem string, fold int")
    df = df.selectExpr("*", "'r' as region", "'c' as commitments", *[f"0 as {c}" for c in MD.NUMS], "array(0.0, 0.0) as embedding")
    cv = MD.model_input(MD.category_indexer(df).transform(MD.with_default_categories(df)))
    ens = MD.train_effort_cv(cv, params=MD.EffortParams(max_iter=8, max_depth=3))
    fitted = ens.ensemble(cv).agg(F.stddev_pop("pred_log")).first()[0]
    spread = df.agg(F.stddev_pop(F.log1p("logged_days"))).first()[0]
    assert fitted < 0.2 * spread


@pytest.mark.parametrize("ranges", [1, 16])
def test_overlapping_sets_in_one_pass(spark, ranges):
    """Every set's statistic is that of its rows alone, for its own rows."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "hot", "u", None]), rng.choice([1, 2, None]), None if rng.random() < 0.1 else rng.uniform(-5, 5), i % 3)
            for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, a string, b int, y double, fold int")
    names, sets = {"a": "a_enc", "b": "b_enc"}, {f"_{j}": F.col("fold") != j for j in range(3)}
    whole = ordered_target_stats(df, names, "y", "k", ranges=ranges, sets=sets)
    assert whole.count() == 300 and whole.filter("a_enc_0 is null or b_enc_2 is null").count() == 0
    for j in range(3):
        part = {r.k: r for r in ordered_target_stats(df.filter(F.col("fold") != j), names, "y", "k", ranges=ranges).collect()}
        got = whole.filter(F.col("fold") != j).collect()
        assert len(got) == len(part) == 200
        for r in got:
            assert (r[f"a_enc_{j}"], r[f"b_enc_{j}"]) == pytest.approx((part[r.k].a_enc, part[r.k].b_enc), abs=1e-9)


def test_all_folds_are_encoded_in_one_pass(spark, monkeypatch):
    calls, encode = [], MD.ordered_target_stats
    monkeypatch.setattr(MD, "ordered_target_stats", lambda *a, **k: calls.append(1) or encode(*a, **k))
    df = spark.range(90).selectExpr("id as ticket_id", "1.0 + id % 7 as logged_days", "concat('s', id % 3) as subsystem", "int(id % 3) as fold",
                                    "'r' as region", "'c' as commitments", *[f"0 as {c}" for c in MD.NUMS], "array(0.0, 0.0) as embedding")
    cv = MD.model_input(MD.category_indexer(df).transform(MD.with_default_categories(df)))
    MD.train_effort_cv(cv.withColumn("logged_days", F.col("logged_days").cast("double")), 3, params=MD.EffortParams(max_iter=1, max_depth=1))
    assert len(calls) == 1
