"""The pipeline: stages in order, decisions take effect, equal to doing it by hand."""

import corpus_pipeline as cp
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from effortlab.llm import mixing
from effortlab.llm.queries import MIX_SHORTFALL, MIX_TARGETS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "near_duplicates", "mixture", "tokens"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    counts = [df.count() for df in stages]
    assert all(a > b for a, b in zip(counts, counts[1:4], strict=False)) and counts[4] == counts[5] > 0


def test_filters_reject_and_keep(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages]
    share = lambda kept, seen, f: len([i for i in seen if i in labels and f(labels[i]) and i in kept]) / max(
        1, len([i for i in seen if i in labels and f(labels[i])]))
    assert share(ids[1], ids[0], lambda r: r.quality == 1) > 0.95
    assert share(ids[1], ids[0], lambda r: r.quality == 0) < 0.1
    assert share(ids[2], ids[1], lambda r: r.toxic == 0) > 0.95
    assert share(ids[2], ids[1], lambda r: r.toxic == 1) < 0.4


def test_one_of_each_group_stays(stages):
    from test_jaccard_trie import brute_force
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert {r.doc_id for r in stages[3].collect()} == {c for _, c in brute_force(rows).values()}


def test_mixture_takes_by_probability(stages):
    drawn = mixing.mix(mixing.describe(stages[3]), MIX_TARGETS, text="text", shortfall=MIX_SHORTFALL).collect()
    assert len([r for r in drawn if r.taken]) > 0.25 * len(drawn)          # scarce cells do not shrink the mixture
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in drawn if r.taken}


def test_tokens_equal_the_library(stages):
    import numpy as np
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages[5].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids


def test_run_equals_the_stages(spark, stages):
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, SF).collect()) == sorted(
        (r.doc_id, r.n_tokens) for r in stages[5].collect())


def test_stages_accept_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", "en", "src0", 0),
                                 (10**9 + 2, "word " * 30_000, "xx", "new", 150_000)], docs.schema)
    last = docs.limit(200).unionByName(odd)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        last = stage(spark, last, SF)
    assert last.count() >= 0
