"""Driver contract smoke test."""

import __spark_entry__ as E


def test_entry_runs_with_stable_schema(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema and a.count() > 0
    assert {"ticket_id", "text", "risk_level", "word_count"} <= set(a.columns)


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
