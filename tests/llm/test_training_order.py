"""Feistel permutation, fixed-stride shards, resumed reads."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from effortlab.llm import queries
from effortlab.llm import training_order as to


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4096, 4097])
def test_permutation_is_a_keyed_bijection(n):
    index = np.arange(n)
    slot = to.permute(index, n, 5)
    assert sorted(slot.tolist()) == list(range(n))
    assert (to.permute(slot, n, 5, inverse=True) == index).all()
    if n > 100:
        assert (to.permute(index, n, 6) != slot).mean() > 0.9
        assert abs(np.corrcoef(index, slot)[0, 1]) < 0.15


def plain_tokens(texts):
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=to.load_ranks(queries.RANKS), special_tokens={})
    return {i: coder.encode_ordinary(t or "") for i, t in texts.items()}


def test_shards_hold_every_token_once_and_resume(spark, tmp_dir):
    texts = {i: f"text number {i} " * (1 + i % 40) for i in range(200)} | {300: None, 301: "", 302: "long words here " * 9000}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, slot string").repartition(5)
    path = f"{tmp_dir}/out"
    manifest = to.write(df, path, queries.RANKS, public_tokenizers.PATTERN, length=64, per_shard=50, end=50256)
    got = to.read(spark, path, length=64, per_shard=50).collect()
    total = manifest.count()
    assert sorted(r.slot for r in got) == list(range(total)) and total > 400
    place = {r.slot: (r.shard, r.offset, r.n_tokens) for r in manifest.collect()}
    assert all(place[r.slot] == (r.shard, r.offset, r.n_tokens) == (r.slot // 50, r.slot % 50 * to.stride(64), len(r.ids) // 2) for r in got)
    tokens = plain_tokens(texts)
    held = np.bincount(np.concatenate([np.frombuffer(r.ids, "<u2") for r in got]), minlength=50257)
    want = np.bincount(np.concatenate([[*t, 50256] for t in tokens.values()]), minlength=50257)
    assert (held == want).all()
    # The pieces of a document, in cutting order, are its tokens.
    with_long = [r for r in manifest.collect() if r.doc_ids == [302]]
    assert len(with_long) >= len(tokens[302]) // 64 - 1
    some = to.read(spark, path, first=70, last=131, length=64, per_shard=50).collect()
    assert sorted(r.slot for r in some) == list(range(70, 131))
    whole = {r.slot: r.ids for r in got}
    assert all(whole[r.slot] == r.ids and r.crc32 == zlib.crc32(r.ids) for r in some)


def test_odd_rows(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id int, text string")
    manifest = to.write(df.coalesce(1), f"{tmp_dir}/a", queries.RANKS, public_tokenizers.PATTERN, length=8, per_shard=2).collect()
    assert sum(r.n_tokens for r in manifest) == 3 + 3 + 2 + 1
    assert {i for r in manifest for i in r.doc_ids} == {1, 2}
    none = to.write(df.limit(0), f"{tmp_dir}/b", queries.RANKS, public_tokenizers.PATTERN)
    assert none.count() == 0 and to.read(spark, f"{tmp_dir}/b").count() == 0


def test_query_holds_every_document(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_training_order(spark, sf).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert sum(r.n_tokens for r in got) == sum(len(t) + 1 for t in plain_tokens(texts).values())
    assert {i for r in got for i in r.doc_ids} == set(texts)
