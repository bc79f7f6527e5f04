"""Text feature expressions (all JVM-side, no Python UDF).

Python's ``str.split()`` / ``str.strip()`` whitespace is wider than Java's
``\\s`` and Spark's ``trim`` (spaces only), so the class is spelled out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python str.isspace() characters: \t\n\v\f\r, \x1c-\x1f, space, NEL, NBSP
# and the Unicode separators (\p{Z}).
PY_WS = r"\x09-\x0D\x1C-\x20\x85\xA0\p{Z}"
WORD_RE = f"[^{PY_WS}]+"
STRIP_RE = f"^[{PY_WS}]+|[{PY_WS}]+$"

# Keyword lists of the task-type flags (substring matches on
# the lower-cased text).  They must stay as given for equal results.
DEV_WORDS = ['разраб', 'dev', 'implement', 'feature', 'фич', 'кодиров']
TEST_WORDS = ['тест', 'test', 'qa', 'проверк', 'autotest', 'автотест']
ANALYSIS_WORDS = ['анализ', 'anali', 'тз', 'требован', 'проектир', 'requirement']

FEATURE_COLUMNS = [
    "has_description", "has_code_block", "is_dev_task", "is_test_task",
    "is_analysis_task", "text_len", "word_count",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(_c(c), STRIP_RE, "")


def fill_text(df: DataFrame, cols=("summary", "description")) -> DataFrame:
    """Null text -> ''."""
    return df.na.fill("", subset=list(cols))


def concat_text(summary="summary", description="description", strip: bool = False) -> Column:
    """``summary + ' ' + description``; optionally stripped (scoring path)."""
    text = F.concat_ws(" ", F.coalesce(_c(summary), F.lit("")), F.coalesce(_c(description), F.lit("")))
    return strip_ws(text) if strip else text


def has_description(description="description") -> Column:
    """1 when the text has a non-whitespace character (``bool(s.strip())``);
    a search that stops at the first such character, no stripped copy."""
    return F.coalesce(_c(description), F.lit("")).rlike(f"[^{PY_WS}]").cast("int")


def has_code_block(description="description") -> Column:
    return F.lower(F.coalesce(_c(description), F.lit(""))).contains("{code").cast("int")


def keyword_flag(text_lower: Column, words) -> Column:
    """1 when any word occurs as a substring of the lower-cased text."""
    return reduce(lambda a, b: a | b, [text_lower.contains(w) for w in words]).cast("int")


def text_len(text="text") -> Column:
    return F.length(_c(text))


def word_count(text="text") -> Column:
    """Number of Python-whitespace separated tokens (``len(s.split())``),
    counted without materialising the tokens."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(WORD_RE)), F.lit(0))


def text_feature_columns(text="text", description="description",
                         dev_words=DEV_WORDS, test_words=TEST_WORDS,
                         analysis_words=ANALYSIS_WORDS) -> dict[str, Column]:
    """The 7 structural features as a name -> expression mapping."""
    lower = F.lower(_c(text))
    return {
        "has_description": has_description(description),
        "has_code_block": has_code_block(description),
        "is_dev_task": keyword_flag(lower, dev_words),
        "is_test_task": keyword_flag(lower, test_words),
        "is_analysis_task": keyword_flag(lower, analysis_words),
        "text_len": text_len(text),
        "word_count": word_count(text),
    }


def text_features(df: DataFrame, text="text", description="description", **kw) -> DataFrame:
    """Add the 7 feature columns in one projection (the lower-cased text is
    computed once and shared by the three keyword flags)."""
    d = df.withColumn("_text_lower", F.lower(_c(text)))
    cols = text_feature_columns(text, description, **kw)
    for name, words in (("is_dev_task", kw.get("dev_words", DEV_WORDS)),
                        ("is_test_task", kw.get("test_words", TEST_WORDS)),
                        ("is_analysis_task", kw.get("analysis_words", ANALYSIS_WORDS))):
        cols[name] = keyword_flag(F.col("_text_lower"), words)
    return d.withColumns(cols).drop("_text_lower")
