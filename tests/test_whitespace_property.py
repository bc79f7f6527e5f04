"""Property: word_count / strip_ws agree with Python's split() / strip() on
random strings rich in Unicode whitespace (checked in one Spark job)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from effortlab.functions import text as T

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000\u200b\u180e"  # the last two are not whitespace
ALPHABET = st.sampled_from(list(WS) + list("ab-Zя9_é{}"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=20, max_size=60))
def test_word_count_and_strip_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", T.word_count("text").alias("w"), T.strip_ws("text").alias("s")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.w == len(t.split()), repr(t)
        assert r.s == t.strip(), repr(t)
