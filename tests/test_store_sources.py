"""Stores (append, replay, marks, upsert) and file sources."""

import json
import os

import pytest

from pyspark.sql import functions as F

from effortlab.sources import csv as CSV
from effortlab.sources import export as X
from effortlab.sources import store as ST


def req(spark, rows):
    return spark.createDataFrame(rows, "summary string, description string, region string, subsystem string, "
                                       "commitments string, predicted_days double, actual_days double")


def test_feedback_append_replay_and_marks(spark, tmp_dir):
    fb, marks = os.path.join(tmp_dir, "fb"), os.path.join(tmp_dir, "marks")
    r = req(spark, [("Task", "", None, "", "SLA", 3.0, 8.0), ("  ", "", "a", "b", "c", 1.0, 1.0),
                    ("Task", "", None, "", "SLA", 3.0, 8.0)])
    ST.append_feedback(r, fb, batch_id=0)
    ST.append_feedback(r, fb, batch_id=0)           # replayed batch
    got = ST.read_feedback(spark, fb, marks)
    assert got.count() == 2 and got.select("id").distinct().count() == 2
    row = got.first()
    assert row.delta_pct == 62.5 and row.region == "Unknown" and row.subsystem == "" and row.is_used_for_training == 0
    ST.mark_used(got.limit(1).select("id"), marks, "run1")
    after = ST.read_feedback(spark, fb, marks)
    assert after.filter("is_used_for_training = 1").count() == 1


def test_model_run_round_trip_and_upsert(spark, tmp_dir):
    path = os.path.join(tmp_dir, "runs")
    first = {"run_id": "run-a", "trigger": "manual", "model_type": "estimate", "r2": 0.5, "mae": 7.0, "rmse": 9.0,
             "overrun_recall": None, "fold_scores": [0.5, 0.75]}
    ST.append_run(spark, path, first)
    ST.append_run(spark, path, {**first, "run_id": "run-b"})
    ST.append_run(spark, path, {**first, "trigger": "feedback", "r2": 0.625, "fold_scores": []})
    runs = {r.run_id: r for r in ST.read_runs(spark, path).collect()}
    assert set(runs) == {"run-a", "run-b"} and (runs["run-a"].trigger, runs["run-a"].r2) == ("feedback", 0.625)
    assert runs["run-b"].fold_scores == [0.5, 0.75]


def test_unreadable_marks_are_an_error(spark, tmp_dir):
    missing, broken = os.path.join(tmp_dir, "none"), os.path.join(tmp_dir, "broken")
    assert ST.read_marks(spark, missing).count() == 0
    os.makedirs(broken)
    with open(os.path.join(broken, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        ST.read_marks(spark, broken).collect()


def test_insert_if_absent(spark):
    runs = spark.createDataFrame([("r1", "estimate")], "run_id string, model_type string")
    defaults = spark.createDataFrame([("d1", "estimate"), ("d2", "risk")], "run_id string, model_type string")
    assert sorted(r.run_id for r in ST.insert_if_absent(runs, defaults).collect()) == ["d2", "r1"]
    assert ST.insert_if_absent(runs, defaults, force=True).count() == 3


def test_seed_csv_rules(spark, tmp_dir):
    path = os.path.join(tmp_dir, "seed.csv")
    with open(path, "w") as f:
        f.write("key,summary,description,time_spent,estimate,region,subsystem,commitments\n")
        f.write('K-1,"multi\nline ""quoted""",d,28800,3,r,s,c\n')
        f.write("K-2,too,many,1,2,3,4,5,6\n")
        f.write("K-3,short,d\n")
        f.write("K-4,bad number,d,abc,2,r,s,c\n")
        f.write("K-5,long with an empty ninth,d,1,2,r,s,c,,x\n")
        f.write("K-6,N/A,null,1,2,None,s,\n")
        f.write('K-7,"short, quoted, commas, many, many, of, them, here, and, here",d\n')
    rows = {r.key: r for r in CSV.read_seed(spark, path).collect()}
    assert set(rows) == {"K-1", "K-3", "K-4", "K-6", "K-7"}
    assert (rows["K-6"].summary, rows["K-6"].description, rows["K-6"].region, rows["K-6"].commitments) == (None,) * 4
    assert rows["K-1"].summary == 'multi\nline "quoted"' and rows["K-1"].time_spent == 28800.0
    assert rows["K-3"].time_spent is None and rows["K-4"].time_spent is None


def test_split_csv_keep_empty(spark, tmp_dir):
    path = os.path.join(tmp_dir, "split.csv")
    with open(path, "w") as f:
        f.write(",".join(CSV.SPLIT_COLUMNS) + "\n")
        f.write('"",1,1,0,NA,,c,0,0,0,0,0,0,0\n')
    keep = CSV.read_split(spark, path, keep_empty=True).first()
    drop = CSV.read_split(spark, path, keep_empty=False).first()
    assert (keep.text, keep.region, keep.subsystem) == ("", "NA", "")
    assert (drop.text, drop.region, drop.subsystem) == (None, None, None)


def test_flatten_issues(spark, tmp_dir):
    page = {"total": 2, "issues": [
        {"key": "A-1", "fields": {"summary": "S", "timespent": 3600, "customfield_10011": 3,
                                  "customfield_11949": [{"value": "b"}, {"value": "a"}],
                                  "customfield_12703": {"value": "X", "child": {"value": "Y"}},
                                  "customfield_12800": {"value": "SLA"}}},
        {"key": "A-2", "fields": {"description": "D"}}]}
    os.makedirs(os.path.join(tmp_dir, "pages"))
    for i in range(2):                                   # the same page twice: duplicates dropped
        with open(os.path.join(tmp_dir, "pages", f"p{i}.json"), "w") as f:
            json.dump(page, f)
    rows = {r.key: r for r in X.flatten_issues(X.read_issue_pages(spark, os.path.join(tmp_dir, "pages"))).collect()}
    assert len(rows) == 2
    a, b = rows["A-1"], rows["A-2"]
    assert (a.region, a.subsystem, a.commitments, a.description) == ("a, b", "X/Y", "SLA", "")
    assert (b.summary, b.region, b.subsystem, b.commitments) == ("", "БАЗОВЫЙ", "", "")


def test_schema_evolve(spark):
    old = spark.createDataFrame([(1,)], "id int")
    new = spark.createDataFrame([(2, "x")], "id int, description string")
    got = {r.id: r.description for r in ST.union_evolved(old, new, {"description": ""}).collect()}
    assert got == {1: "", 2: "x"}
    assert F is not None


def test_split_csv_round_trip_keeps_whitespace(spark, tmp_dir):
    cols = CSV.SPLIT_COLUMNS
    row = ["Task  ", 3.0, 1.0, 0, " r", "s ", "c", 1, 0, 0, 0, 0, 6, 1]
    schema = ("text string, estimate double, logged_days double, risk_level int, region string, subsystem string, "
              "commitments string, has_description int, has_code_block int, is_dev_task int, is_test_task int, "
              "is_analysis_task int, text_len int, word_count int")
    df = spark.createDataFrame([row], schema).withColumn("split", F.lit("train"))
    path = os.path.join(tmp_dir, "splits")
    CSV.write_splits(df, path, fmt="csv")
    back = CSV.read_split(spark, os.path.join(path, "split=train")).select(*cols).first()
    assert list(back) == row


def test_flatten_issues_moves_a_text_once(spark):
    """The aggregate's buffer holds each column once; versions are chosen as by all columns in order."""
    pages = spark.createDataFrame([(3, [("K", {"summary": "a", "description": "old", "timespent": 1.0}),
                                        ("K", {"summary": "b", "description": None, "timespent": None}),
                                        ("K", {"summary": "b", "description": "new", "timespent": 1.0})]),
                                   (1, [("L", {"summary": None, "description": "x", "timespent": None})])], X.PAGE_SCHEMA)
    flat = X.flatten_issues(pages)
    assert flat.columns == ["key", "summary", "description", "time_spent", "estimate", "created_at", "status", "project",
                            "region", "subsystem", "commitments"]
    assert {r.key: (r.summary, r.description, r.time_spent, r.region) for r in flat.collect()} == {
        "K": ("b", "new", 1.0, "БАЗОВЫЙ"), "L": ("", "x", None, "БАЗОВЫЙ")}
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "maxby" not in plan
