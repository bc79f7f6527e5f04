"""TF-IDF and LSA properties against dense numpy references."""

import math

import numpy as np
from pyspark.sql import functions as F

from effortlab.operators import text as TX
from tests.conftest import SF001


def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id"), "text")


def test_tokens_match_python(spark):
    import re
    rows = docs(spark).select("text", TX.tokens("text").alias("t")).limit(50).collect()
    for r in rows:
        assert r.t == re.findall(r"(?u)\b\w\w+\b", r.text.lower())


def test_unit_norms_and_idf(spark):
    d = docs(spark)
    model, w = TX.fit_transform_tfidf(d, F.col("doc_id") % 2 == 0, "doc_id", "text", 2, 500)
    norms = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert all(math.isclose(r.n, 1.0, rel_tol=1e-9) for r in norms)
    assert model.size == 500
    v = model.vocab.orderBy("term_idx").collect()
    assert [r.term for r in v] == sorted(r.term for r in v)
    n = d.filter(F.col("doc_id") % 2 == 0).count()
    assert all(math.isclose(r.idf, math.log((1 + n) / (1 + r.df)) + 1) for r in v)


def test_lsa_matches_dense_svd(spark):
    d = docs(spark)
    model, w = TX.fit_transform_tfidf(d, F.lit(True), "doc_id", "text", 2, 300)
    lsa = TX.fit_lsa(w, model.size, 8, "doc_id")
    ids = sorted(r.doc_id for r in d.select("doc_id").collect())
    pos = {i: k for k, i in enumerate(ids)}
    A = np.zeros((len(ids), model.size))
    for r in w.collect():
        A[pos[r.doc_id], r.term_idx] = r.weight
    s = np.linalg.svd(A, compute_uv=False)[:8]
    assert np.allclose(lsa.singular_values, s, rtol=1e-6)
    V = lsa.components
    assert np.allclose(V.T @ V, np.eye(8), atol=1e-8)
    big = np.abs(V).argmax(axis=0)
    assert (V[big, np.arange(8)] > 0).all()
    emb = {r.doc_id: r.embedding for r in lsa.transform(w, "doc_id", docs=d).collect()}
    dense = A @ V
    assert all(np.allclose(emb[i], dense[pos[i]], atol=1e-9) for i in ids)
    ratio = TX.explained_variance(w, lsa.transform(w, "doc_id", docs=d), len(ids), 8).first()[0]
    X = A @ V
    assert math.isclose(ratio, X.var(axis=0).sum() / A.var(axis=0).sum(), rel_tol=1e-6)


def test_document_rows_hold_the_long_weights(spark):
    """One row per document, repeated and null ids included, written once: the same
    weights, and the same embedding with nothing shuffled."""
    docs = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "beta gamma"), (2, "alpha delta"), (3, ""), (4, None),
                                  (None, "gamma alpha"), (5, "delta unknown alpha beta")], "ticket_id int, text string")
    model, long = TX.fit_transform_tfidf(docs, F.lit(True))
    again, rows = TX.fit_transform_rows(docs, F.lit(True))
    assert again.size == model.size
    key = lambda r: (r.ticket_id or 0, r.term_idx)
    a, b = sorted(long.collect(), key=key), sorted(TX.long_weights(rows).collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and len(a) > 8
    assert max(abs(x.weight - y.weight) for x, y in zip(a, b)) < 1e-12
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
    basis = np.arange(model.size * 2, dtype=float).reshape(-1, 2) - 3
    lsa = TX.LsaModel(basis, np.ones(2), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(basis)], "term_idx int, comp array<double>"))
    whole = {r.ticket_id: r.embedding for r in lsa.transform(long, docs=docs).collect()}
    quick = lsa.transform(rows, docs=docs)
    assert "Exchange" not in lsa.transform(rows)._jdf.queryExecution().executedPlan().toString()
    got = {r.ticket_id: r.embedding for r in quick.collect()}
    assert set(got) == set(whole) and all(np.allclose(got[i], whole[i]) for i in got)


def test_lsa_finds_every_copy_of_a_singular_value(spark):
    """Singular values that occur many times are found as often as they occur, in few jobs;
    documents without a term count for nothing."""
    pairs = [(2 * i, 0.6, 2 * i + 1, 0.8) for i in range(520) for _ in range(4 if i < 20 else 2 if i < 40 else 1)]
    rows = [(n, [(a, x), (b, y)]) for n, (a, x, b, y) in enumerate(pairs)] + [(-1, []), (-2, None)]
    w = spark.createDataFrame(rows, "ticket_id long, weights array<struct<term_idx int, weight double>>")
    sc = spark.sparkContext
    sc.setJobGroup("lsa", "lsa")
    try:
        lsa = TX.fit_lsa(w, 1040, 30)
        assert len(sc.statusTracker().getJobIdsForGroup("lsa")) < 60
    finally:
        sc.setJobGroup("", "")
    assert np.allclose(lsa.singular_values, [2.0] * 20 + [math.sqrt(2)] * 10, rtol=1e-9)
    V = lsa.components
    assert np.allclose(V.T @ V, np.eye(30), atol=1e-9)
    got = np.array([r.embedding for r in lsa.transform(w).collect()])
    assert np.allclose(got.T @ got, np.diag(lsa.singular_values ** 2), atol=1e-8)


def test_block_decomposition_of_few_dimensions(spark):
    """More components asked for than there are: only those there are, equal to a dense decomposition."""
    rng = np.random.default_rng(3)
    A = np.zeros((90, 1100))
    A[:, :] = rng.standard_normal((90, 7)) @ rng.standard_normal((7, 1100))
    w = spark.createDataFrame([(i, [(j, float(x)) for j, x in enumerate(r)]) for i, r in enumerate(A)],
                              "ticket_id long, weights array<struct<term_idx int, weight double>>")
    s, V = TX.block_svd(w, 1100, 20)
    want = np.linalg.svd(A, compute_uv=False)[:7]
    assert np.allclose(s[:7], want, rtol=1e-9) and (s[7:] < want[0] * 1e-6).all()
    assert np.allclose(np.linalg.norm(A @ V[:, :7], axis=0), want, rtol=1e-9)


def test_long_batches_are_embedded_some_tokens_at_a_time(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(2)
    terms, idf, basis = pa.array([f"t{i}" for i in range(50)]), rng.random(50) + 1, rng.random((50, 3))
    lists = pa.array([None if i % 7 == 3 else [f"t{j}" for j in rng.integers(0, 60, rng.integers(0, 40))] for i in range(90)], pa.list_(pa.string()))
    whole = TX.embed_token_lists(lists, terms, idf, basis).to_pylist()
    seen, inner = [], TX._embed_into
    monkeypatch.setattr(TX, "EMBED_TOKENS", 64)
    monkeypatch.setattr(TX, "_embed_into", lambda out, some, *rest: (seen.append((len(some), len(some.flatten()))), inner(out, some, *rest)))
    assert TX.embed_token_lists(lists, terms, idf, basis).to_pylist() == whole
    assert TX.embed_token_lists(lists.slice(10, 30), terms, idf, basis).to_pylist() == whole[10:40]
    assert len(seen) > 20 and all(tokens <= 64 or rows == 1 for rows, tokens in seen)


def test_products_some_vectors_at_a_time_are_the_same_to_the_last_bit(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 30, 200)
    begins, terms, weights = np.cumsum(sizes) - sizes, rng.integers(0, 90, sizes.sum()).astype(np.int32), rng.random(sizes.sum())
    x = rng.random((90, 12))
    monkeypatch.setattr(TX, "GRAM_WEIGHTS", 100)
    few = TX.gram_product(begins, terms, weights, x)
    monkeypatch.setattr(TX, "GRAM_VECTORS", 12)
    assert (few == TX.gram_product(begins, terms, weights, x)).all()
    dense = np.zeros((200, 90))
    np.add.at(dense, (np.repeat(np.arange(200), sizes), terms), weights)
    assert np.allclose(few, dense.T @ (dense @ x))
