"""BPE: equal to plain merging and to the library, on words, odd texts and rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from effortlab.llm import bpe, common, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.load_rules(PATH), bpe.split_pattern())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_merging(coder, word: bytes) -> list[int]:
    ids = [coder.vocab[bytes((b,))] for b in word]
    merged = {pair: coder.vocab[coder.bytes_of[pair[0]] + coder.bytes_of[pair[1]]] for pair in coder.rank}
    while True:
        found = [(coder.rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in coder.rank]
        if not found:
            return ids
        _, i = min(found)
        ids[i:i + 2] = [merged[ids[i], ids[i + 1]]]


def test_trie_equals_plain_merging(coder):
    rng = random.Random(4)
    words = {bytes(rng.choice(b"aabbcdethrin '\xc3\xa9") for _ in range(rng.randint(1, 14))) for _ in range(1500)}
    got = coder.encode_words(words)
    for w in words:
        assert np.frombuffer(got[w], "<u4").tolist() == plain_merging(coder, w), w


def test_odd_texts_equal_the_library(coder, library):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "日本", "1", "23", "!", "...", "<|endoftext|>", "'s", "'", " ",
             "\x1c", "\x85", "😀", "the", " the", "aaaa", "　", "_", "ll", "Ᲊ", "\U0001e5f1"]
    texts = ["", " ", "a" * 5000, " " * 5000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000))]
    for t, ids in zip(texts, coder.encode_batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_memory_is_bounded_and_does_not_change_results(monkeypatch, coder):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    small = bpe.Encoder(bpe.load_rules(PATH), bpe.split_pattern())
    texts = [f"word{i % 97}, other{i % 13} text." for i in range(400)]
    for lo in range(0, 400, 10):
        assert small.encode_batch(texts[lo:lo + 10]) == coder.encode_batch(texts[lo:lo + 10])
        assert len(small.known) <= 20 + 200


def test_rows(spark):
    rows = [(1, "hello", 5, "x"), (2, None, 6, "y"), (3, "", 7, None), (1, "hello", 5, "x"), (None, "a b", 8, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, IDS string")
    got = bpe.encode(df, PATH, decode=True)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]        # clashing names are replaced
    out = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == 5
    assert out[2, None].n_tokens == out[3, ""].n_tokens == 0 and out[2, None].decoded == ""
    assert out[None, "a b"].decoded == "a b"
    again = bpe.decode(got, PATH, out="back").collect()
    assert all(r.back == r.decoded for r in again)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_bpe_trie(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_a_task_takes_a_batch_apart_in_small_parts():
    """Pieces of a text take many times its memory: no part of a batch is larger than a megabyte and a text."""
    batch = pa.RecordBatch.from_pydict({"text": ["word " * 50_000] * 12})
    parts = list(bpe._slices(batch, "text"))
    assert sum(len(texts) for _, texts in parts) == sum(b.num_rows for b, _ in parts) == 12
    assert max(sum(map(len, texts)) for _, texts in parts) <= 1_250_000


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "trim", lambda: calls.append(1))
    run = common.tidy(lambda batches: (x + 1 for x in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and calls == [1]


def test_tokens_that_end_at_a_place_are_found_by_states(coder):
    """A state of the automaton is the longest beginning of a token that the bytes read end with; the
    tokens that end there come longest first, and tables that were made once and sent give the same encoder."""
    vocab = {b"a": 0, b"b": 1, b"ab": 2, b"bab": 3, b"abab": 4, b"c": 5, b"abc": 6}
    rules = {"vocab": vocab, "merges": [(b"a", b"b"), (b"b", b"ab"), (b"ab", b"ab"), (b"ab", b"c")], "special": {}}
    small = bpe.Encoder(bpe.with_tables(rules), bpe.split_pattern())
    rng = random.Random(6)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(400)}
    for w in words:
        state = 0
        for end, b in enumerate(w, 1):
            state = small.goes[state << 8 | b] if state << 8 | b in small.goes else small._step(state << 8 | b)
            found, ends = [], small.token[state]
            while ends:
                found.append(small.id_of[ends])
                ends = small.shorter[ends]
            assert found == [vocab[w[s:end]] for s in range(end) if w[s:end] in vocab]
    for w, ids in small.encode_words(words).items():
        assert np.frombuffer(ids, "<u4").tolist() == plain_merging(small, w), w
    sent = bpe.Encoder(bpe.with_tables(bpe.load_rules(PATH)), bpe.split_pattern())
    texts = ["The quick brown fox, it's 123 …", "supercalifragilistic  \n naïve 日本"]
    assert sent.encode_batch(texts) == coder.encode_batch(texts)
    with pytest.raises(ValueError, match="no token ends"):
        small.encode_words([b"abx"])
