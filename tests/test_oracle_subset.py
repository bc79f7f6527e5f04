"""Registered queries against their DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from effortlab.sources.tables import TABLES
from tests.conftest import SF001

CHECKED = ["prepare_dataset", "text_features", "parse_region", "parse_subsystem", "parse_commitments",
           "stratified_split", "kfold_assign", "percentile_bounds", "baseline_report", "error_report",
           "classification_report", "tfidf", "vocabulary_topk", "metrics_report", "recent_runs",
           "category_profile", "augment_with_feedback", "feedback_metrics"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    srows = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    drows = sorted(repr(tuple(norm(r[i]) for i in idx)) for r in rel.fetchall())
    assert srows == drows
