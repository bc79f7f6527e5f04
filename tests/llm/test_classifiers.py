"""Quality and toxicity classifiers: held-out accuracy, exact parts against plain
versions, odd rows."""

import math
import os
import subprocess
import sys
import unicodedata
import zlib

import numpy as np
import pytest

from effortlab.llm import quality_gam, queries, toxicity_nb

SF = "/root/testdata/sf0.1"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def auc(score, y):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(y)[order]
    rank = np.searchsorted(s, s, "left") + (np.searchsorted(s, s, "right") - np.searchsorted(s, s, "left") + 1) / 2
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out_auc(spark, query, label, folds, fold):
    got = query(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    score, y, predicted = (np.array(x) for x in zip(*known, strict=True))
    return auc(score, y), (predicted == y).mean()


def test_quality_on_held_out_rows(spark):
    area, right = held_out_auc(spark, queries.op10_quality_gam, "quality", 4, 2)
    assert area > 0.95 and right > 0.93


def test_toxicity_on_held_out_rows(spark):
    area, right = held_out_auc(spark, queries.op2_toxicity_nb, "toxic", 5, 0)
    assert area > 0.95 and right > 0.95


def all_codes(text):
    return np.concatenate([np.empty(0, np.uint64), *(c for orders in toxicity_nb.ngrams(text) for c in orders)])


def plain_code(gram):
    """Polynomial of the code points, told apart by length."""
    code = 0
    for c in gram:
        code = (code * 0x9E3779B185EBCA87 + ord(c)) % 2 ** 64
    return (code + len(gram)) * 0x9E3779B185EBCA87 % 2 ** 64


def plain_ngrams(text):
    flat = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower())
    flat = " " + " ".join(flat.split(" ")) + " "
    while "  " in flat:
        flat = flat.replace("  ", " ")
    return [flat[i:i + n] for n in toxicity_nb.ORDERS for i in range(len(flat) - n + 1)]


TEXTS = ["Ab, c!\n\nÉ1", "Привет, мир — ДА", "你好，世界。再见", "Γεια σου Κόσμε", "a😀b 𝒳𝓎 𐐀𐐁 x", "नमस्ते दुनिया", "", " ,.", "a", "  a  b  "]


def test_ngrams_are_the_ngrams_of_characters():
    for t in TEXTS:
        assert sorted(all_codes(t).tolist()) == sorted(map(plain_code, plain_ngrams(t))), t
    assert "你好" in " ".join(plain_ngrams(TEXTS[2])) and plain_code("мир") in all_codes(TEXTS[1]).tolist()


def test_strides_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abé ,你X\n"), 400)) for _ in range(20)] + TEXTS
    want = [sorted(all_codes(t).tolist()) for t in texts]
    for stride in (1, 7, 50):
        monkeypatch.setattr(toxicity_nb, "STRIDE", stride)
        assert [sorted(all_codes(t).tolist()) for t in texts] == want


def test_counts_and_ratios_equal_plain_counting(spark, monkeypatch):
    """Documents per n-gram and class, with long texts in strides; the features that a fit takes."""
    rng = np.random.default_rng(6)
    rows = [(i, "".join(rng.choice(list("abcd é"), 60)) + ("你坏蛋" if i % 3 == 0 else "你好吗"), int(i % 3 == 0)) for i in range(60)]
    rows += [(100, None, 1), (101, "", 0), (100, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    held = [(set(map(plain_code, plain_ngrams(t or ""))), y) for _, t, y in rows]
    codes = set().union(*(c for c, _ in held))
    want = {c: (sum(y for s, y in held if c in s), sum(1 - y for s, y in held if c in s)) for c in codes}
    for stride in (1_000_000, 20):
        monkeypatch.setattr(toxicity_nb, "STRIDE", stride)
        got = {r.code % 2 ** 64: (r.pos, r.neg) for r in toxicity_nb._count(df, "text").collect()}
        assert got == want
    model = toxicity_nb.fit(df.select("doc_id", "text"), df.selectExpr("doc_id", "y as toxic").filter("doc_id < 100"), min_docs=2, min_z=2.0)
    n1, n0 = 20, 40
    short = [(c, y) for (c, y), (i, _, _) in zip(held, rows) if i < 100]
    taken = {}
    for c in codes:
        p, q = sum(y for s, y in short if c in s) + 1, sum(1 - y for s, y in short if c in s) + 1
        ratio = math.log(p / (n1 + 2)) - math.log(q / (n0 + 2))
        if p + q - 2 >= 2 and abs(ratio) / math.sqrt(1 / p + 1 / q) >= 2.0:
            taken[c] = ratio
    assert set(model.codes.tolist()) == set(taken) and plain_code("坏蛋 ") in taken
    assert all((w > 0) == (taken[c] > 0) for c, w in zip(model.codes.tolist(), model.weights.tolist()) if abs(w) > 1e-6)


def test_the_fit_is_at_its_optimum():
    """No direction lowers the regularised loss: its gradient is near 0."""
    rng = np.random.default_rng(8)
    rows = [np.flatnonzero(rng.random(30) < 0.2) for _ in range(300)]
    y, weight, scale = (rng.random(300) < 0.4).astype(float), rng.uniform(0.5, 2, 300), rng.normal(size=30)
    v, base = toxicity_nb._fit_linear(rows, y, weight, scale, ridge=1.0)
    x = np.zeros((300, 30))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    off = weight * (1 / (1 + np.exp(-(x @ v + base))) - y)
    assert np.abs(x.T @ off + v).max() < 0.05 and abs(off.sum()) < 0.05


def test_a_very_long_text_in_little_memory():
    """50 MB are scored within 500 MB."""
    code = """
import resource, numpy as np
from effortlab.llm import toxicity_nb as T
codes = np.unique(np.concatenate([c for o in T.ngrams('some bad words here and others') for c in o]))
look = T.Lookup(codes)
text = 'plain text of words, ' * 2_400_000 + 'some bad words'
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = len(look.present(text))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True).stdout.split()
    assert int(said[0]) > 10 and int(said[1]) < 500


def test_lookup_equals_sets():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc d"), 60)) for _ in range(50)]
    codes = np.unique(np.concatenate([all_codes(t) for t in texts[:20]]))[::3]
    look = toxicity_nb.Lookup(codes)
    for t in texts:
        have = set(all_codes(t).tolist())
        assert look.present(t).tolist() == [i for i, c in enumerate(codes.tolist()) if c in have]


def test_best_leaves_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        got = quality_gam._leaves(g, h, 1.0, 2)
        best = max(range(1, 9), key=lambda c: sum(p.sum() ** 2 / (w.sum() + 1) for p, w in ((g[:c], h[:c]), (g[c:], h[c:]))))
        want = np.r_[np.full(best, g[:best].sum() / (h[:best].sum() + 1)), np.full(9 - best, g[best:].sum() / (h[best:].sum() + 1))]
        assert np.allclose(got, want)
        g2, h2 = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
        gain, steps = quality_gam._quadrants(g2, h2, 1.0)
        plain = max(sum(g2[a, b].sum() ** 2 / (h2[a, b].sum() + 1) for a in (slice(0, i), slice(i, 4)) for b in (slice(0, j), slice(j, 5)))
                    for i in range(1, 4) for j in range(1, 5)) - g2.sum() ** 2 / (h2.sum() + 1)
        assert math.isclose(gain, plain) and len(np.unique(steps)) <= 4


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = np.zeros((3000, len(quality_gam.STATISTICS)))
    x[:, :2] = rng.random((3000, 2))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)          # no single statistic tells
    model = quality_gam.learn(x, y, np.ones(3000), rounds=20, pair_rounds=60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    by_hand = model.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, x[7], strict=True))
    by_hand += sum(t[np.searchsorted(model.grids[a], x[7, a], side="right"), np.searchsorted(model.grids[b], x[7, b], side="right")]
                   for a, b, t in model.pairs)
    assert math.isclose(model.logit(x[7:8])[0], by_hand)


@pytest.mark.parametrize("op", [quality_gam, toxicity_nb])
def test_odd_rows(spark, op):
    docs = [(i, ("good text here. " if i % 2 else "bad | | zz ") * (1 + i % 5), "x") for i in range(60)]
    odd = [(100, None, "x"), (101, "", None), (102, " \n", "x"), (None, "good", "x"), (1, docs[1][1], "x"), (103, "word " * 50_000, "x")]
    df = spark.createDataFrame(docs + odd, "doc_id bigint, text string, SCORE string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, 0), (None, 1), (6, None), (100, 0), (999, 1)], "doc_id bigint, y int")
    settings = {"min_z": 1.0} if op is toxicity_nb else {"rounds": 10, "pair_rounds": 5}
    model = op.fit(df, labels, label="y", **settings)
    got = op.score(df, model)
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    assert len(rows) == 66 and all(0 <= r.score <= 1 for r in rows)
    assert sum((r.score > 0.5) == (r.doc_id % 2 == 1) for r in rows if r.doc_id and r.doc_id < 60) >= 55
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    none = op.fit(df, labels.limit(0), label="y", **settings)
    assert {r.score for r in op.score(df, none).collect()} == {0.5}
    assert op.score(df.limit(0), model).count() == 0


@pytest.mark.parametrize("op", [quality_gam, toxicity_nb])
def test_labels_of_missing_documents_do_not_count(spark, op):
    """Labels of documents that are gone neither use up the sample nor shift the classes."""
    docs = spark.createDataFrame([(i, ("good text here. " if i % 2 else "bad | | zz ") * (1 + i % 5)) for i in range(60)],
                                 "doc_id bigint, text string")
    own = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, y int")
    gone = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000, 6000)], "doc_id bigint, y int")
    settings = {"label": "y", "per_class": 40} | ({"min_z": 1.0} if op is toxicity_nb else {"rounds": 10, "pair_rounds": 5})
    scores = [{r.doc_id: r.score for r in op.score(docs, op.fit(docs, labels, **settings)).collect()}
              for labels in (own, own.unionByName(gone))]
    assert scores[0] == pytest.approx(scores[1])
    assert sum((s > 0.5) == (i % 2 == 1) for i, s in scores[1].items()) >= 55
