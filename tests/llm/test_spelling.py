"""Spelling variants: equal to plain comparison of all words, whatever the parts; the query equals its SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from effortlab.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n long"


def plain_words(rows, min_length=7):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_length and k >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def plain_groups(n, times=10):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made_words(seed, letters, size, count):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, size))) for _ in range(count)}
    for w in sorted(words):
        for _ in range(2):
            p = rng.randrange(len(w))
            v = rng.choice([w[:p] + w[p + 1:], w[:p] + rng.choice(letters) + w[p:], w[:p] + rng.choice(letters) + w[p + 1:]])
            if len(v) >= 7:
                words.add(v)
    return {w: rng.choice([2, 3, 20, 25, 200, 300, 2000, 25_000]) for w in sorted(words)}


@pytest.mark.parametrize("parts", [2, 3, 5])
@pytest.mark.parametrize("letters,size,count", [("abcdefghijklmnopqrstuvwxyzéß÷", 12, 60), ("ab", 9, 60), ("aé", 8, 40)])
def test_groups_equal_plain_comparison(spark, parts, letters, size, count):
    n = made_words(parts, letters, size, count)
    got = spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"), parts=parts).collect()
    assert sorted(map(tuple, got)) == plain_groups(n)


def test_long_chains_reach_their_root(spark):
    word = "abcdefgh"
    chain = {word[:7] + "z" * k: 2 * 10 ** k for k in range(1, 14)}
    got = spelling.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == plain_groups(chain)
    assert {r.root for r in got} == {word[:7] + "z" * 13}


def test_words_of_odd_texts(spark):
    rows = [(1, None, "x", 1), (None, "Nullable nullable NULLABLE", "x", 1), (2, "", "x", 1), (2, "  ", "x", 1), (3, "ÀÉÿ×÷bcd ÀÉÿ×÷bcd", "x", 1),
            (4, "tokenised,tokenised\ntokenized😀tokenised日tokenised", "x", 1), (5, "Tokenised " * 900, "x", 1),
            (6, "q" * 100_000 + " " + "q" * 100_000, "x", 1), (7, "abcdefg-" * 1000, "x", 1), (7, "abcdefg-" * 1000, "x", 1), (-8, "Ǆabcdefgh ŉabcdefgh", "x", 1)]
    rows += [(i, "Shakespeare wrote wonderful sonnets", "x", 1) for i in range(100, 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.word: r.n for r in spelling.counted(spelling.misspelt(spelling.runs(df))).collect()}
    assert got == plain_words(rows) and len(got) > 10
    assert spelling.group_variants(spelling.counted(spelling.misspelt(spelling.runs(df.limit(0))))).count() == 0
    groups = spelling.group_variants(spelling.counted(spelling.misspelt(spelling.runs(df)))).collect()
    assert sorted(map(tuple, groups)) == plain_groups(plain_words(rows))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE["op11_spelling"]).fetchall()
    got = queries.QUERIES["op11_spelling"](spark, f"/root/testdata/{sf}")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    key = lambda r: r[0]
    assert want and sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    if sf == "sf0.001":
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
        assert sorted(want, key=key) == plain_groups(plain_words(rows))
