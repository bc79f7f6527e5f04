"""Literal cases of the structural text features (mixed Cyrillic/English)."""

import pytest
from pyspark.sql import functions as F

from effortlab.functions import text as T


def features(spark, summary, description):
    df = spark.createDataFrame([(summary, description)], "summary string, description string")
    df = df.withColumn("text", T.concat_text("summary", "description"))
    return T.text_features(df).select(*T.FEATURE_COLUMNS).first().asDict()


@pytest.mark.parametrize("summary,description,key,expected", [
    ("Склад", "", "has_description", 0),
    ("Склад", "Полки стоят криво", "has_description", 1),
    ("Log", "see {code:java}f();{code}", "has_code_block", 1),
    ("Log", "code without braces", "has_code_block", 0),
    ("Кодирование штрихов", "", "is_dev_task", 1),
    ("A FEATURE for couriers", "", "is_dev_task", 1),
    ("Склад", "перепроверка весов", "is_test_task", 1),
    ("Проектирование склада", "", "is_analysis_task", 1),
    ("Задача", "   \t\n", "has_description", 0),
    ("Задача", "{CODE", "has_code_block", 1),
    ("Оставить отзыв", "", "is_analysis_task", 1),
    ("analysis of logs", "", "is_analysis_task", 0),
])
def test_feature_cases(spark, summary, description, key, expected):
    assert features(spark, summary, description)[key] == expected


def test_length_and_words(spark):
    text = " Склад №7:\tпринять 40 паллет, пока\nсухо 🌤 "
    df = spark.createDataFrame([(text,)], "text string")
    r = df.select(T.text_len("text").alias("n"), T.word_count("text").alias("w")).first()
    assert (r.n, r.w) == (len(text), len(text.split()))


def test_unicode_whitespace_splits_words(spark):
    texts = ["a b", " x  y\tz\n", "", "   ", "a b　c", "a​b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.w for r in df.select(T.word_count("text").alias("w")).collect()]
    assert got == [len(t.split()) for t in texts]


def test_no_flags(spark):
    r = features(spark, "Заказать кресла в офис", "Шесть штук, синие.")
    assert (r["is_dev_task"], r["is_test_task"], r["is_analysis_task"]) == (0, 0, 0)


def test_exactly_seven_columns(spark):
    assert len(features(spark, "Задача", "Описание")) == 7


def test_strip_matches_python(spark):
    texts = ["  a b \n", " x ", "x", "\t\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.s for r in df.select(T.strip_ws("text").alias("s")).collect()]
    assert got == [t.strip() for t in texts]


def test_concat_offline_unstripped_and_scoring_stripped(spark):
    df = spark.createDataFrame([("Задача", "")], "summary string, description string")
    r = df.select(T.concat_text().alias("a"), T.concat_text(strip=True).alias("b")).first()
    assert (r.a, r.b) == ("Задача ", "Задача")
    assert df.select(F.length(T.concat_text()).alias("n")).first().n == 7
