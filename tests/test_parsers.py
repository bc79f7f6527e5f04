"""Option-field literal parsers."""

import pytest

from effortlab.functions import parse as P


def one(spark, fn, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    return df.select(fn("raw").alias("v")).first().v


@pytest.mark.parametrize("raw,expected", [
    ("[{'value': 'b'}, {'value': 'a'}]", "a, b"),
    ("[]", "БАЗОВЫЙ"), (None, "БАЗОВЫЙ"), ("oops", "БАЗОВЫЙ"), ("5", "БАЗОВЫЙ"),
    ("[1]", ""),
    ("[{'id': '3'}]", "БАЗОВЫЙ"),
    ("{'value': 'x'}", "БАЗОВЫЙ"),
    ("[{'value': None}, {'value': 'z'}]", "z, БАЗОВЫЙ"),
    (r"[{'value': 'a\xa0b'}]", "a\u00a0b"), ("[{'value': 'a'},]", "a"), ("[{'value': 'a'}] junk", "БАЗОВЫЙ"),
    (r"[{'value': 'it\'s, ]x'}]", "it's, ]x"), (r"[{'value': 'back\\x41'}]", r"back\x41"), ("[[1], {'value': 'q'}]", "q"),
])
def test_region(spark, raw, expected):
    assert one(spark, P.parse_region, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("{'value': 'X', 'child': {'value': 'Y'}}", "X/Y"),
    ("{'value': 'X'}", "X"),
    ("{'value': 'X/', 'child': {'value': ''}}", "X"),
    ("oops", ""), (None, ""), ("[1]", ""), ("{'id': 1}", ""),
    (r"{'value': 'a\xe9'}", "a\u00e9"), ("{'value': 'X', 'child': {'value': 'Y',},}", "X/Y"), ("{'value': 'X'} junk", ""),
])
def test_subsystem(spark, raw, expected):
    assert one(spark, P.parse_subsystem, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("{'value': 'SLA'}", "SLA"), ("[1]", ""), (None, ""), ("{}", ""),
])
def test_commitments(spark, raw, expected):
    assert one(spark, P.parse_commitments, raw) == expected


def test_struct_variants(spark):
    df = spark.createDataFrame(
        [([{"value": "b"}, {"value": "a"}], {"value": "X", "child": {"value": "Y"}}, {"value": "SLA"}),
         ([], None, None)],
        "r array<struct<value:string>>, s struct<value:string, child:struct<value:string>>, c struct<value:string>")
    rows = df.select(P.region_from_struct("r").alias("r"), P.subsystem_from_struct("s").alias("s"),
                     P.commitments_from_struct("c").alias("c")).collect()
    assert [tuple(r) for r in rows] == [("a, b", "X/Y", "SLA"), ("БАЗОВЫЙ", "", "")]


def test_plain_spelling_takes_no_token_by_token_step(spark, monkeypatch):
    from pyspark.sql import functions as F
    plain = ["[{'value': 'b'}, {'value': 'a'}]", "{'value': 'X', 'child': {'value': 'Y'}}", "[1]", "[]", "{'all': [" + "[], " * 1500 + "], 'value': 'q'}"]
    monkeypatch.setattr(P, "_json", lambda text: F.lit(None).cast("string"))
    rows = spark.createDataFrame([(t,) for t in plain], "raw string").select(P._root("raw").alias("v")).collect()
    assert all(r.v for r in rows)
