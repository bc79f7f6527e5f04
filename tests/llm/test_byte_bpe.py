"""Byte-level BPE by the library: equal to merging by ranks, on odd and long texts, with spans and split characters."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from effortlab.llm import byte_bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "日本", "1", "23", "!", "...", "<|endoftext|>", "'s", "'", "\xa0",
         "\x1c", "\x85", "😀", "the", " the", "aaaa", "　", "_", "ll", "Ᲊ", "\U0001e5f1", "﻿", "é"]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(byte_bpe.tokenizer_spec(PATH, PATTERN))


@pytest.fixture(scope="module")
def by_ranks():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def odd_texts(n=2500, seed=5):
    rng = random.Random(seed)
    return ["", " ", "a" * 3000, " " * 3000, "ab" * 2000, "é" * 999,
            *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n))]


def test_ids_equal_merging_by_ranks(coder, by_ranks):
    texts = odd_texts()
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == by_ranks.encode_ordinary(t), t
        assert coder.raw(ids.tolist()) == t.encode()


def test_every_kind_of_character(coder, by_ranks):
    chars = [chr(c) for c in [*range(1, 0x3100), *range(0x1C80, 0x1C90), *range(0xA640, 0xAB70), *range(0x1E000, 0x1F000)]
             if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}1{c} {c}a{c}{c}" for c in chars]
    assert [x.tolist() for x in coder.encode(texts)] == [by_ranks.encode_ordinary(t) for t in texts]


def test_cutting_long_texts_changes_nothing(coder, by_ranks):
    rng = random.Random(8)
    for size in (1, 7, 50):
        for _ in range(60):
            t = "".join(rng.choice(PARTS) for _ in range(200))
            assert "".join(coder.strides(t, size)) == t
            assert coder.encode([t, "", t], size)[2].tolist() == by_ranks.encode_ordinary(t)


def test_memory_is_bounded_and_changes_nothing(coder, by_ranks, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    monkeypatch.setattr(byte_bpe, "LONGEST", 6)
    small = byte_bpe.Coder(coder.library.to_str())
    texts = [f"word{i % 97}, other{i % 13} text  of\u00a0 {'long' * (i % 5)}." for i in range(400)]
    for lo in range(0, 400, 10):
        part = texts[lo:lo + 10]
        assert [x.tolist() for x in small.encode(part)] == [by_ranks.encode_ordinary(t) for t in part]
    assert len(small.known) < 100 and len(small.before) < 100 and all(len(k) <= 6 for k in small.known)


def test_spans_equal_the_library(coder):
    for t in odd_texts(600, 9):
        e = coder.library.encode(t, add_special_tokens=False)
        begins, ends, inside = coder.spans(t, np.array(e.ids, np.int32))
        assert list(zip(begins.tolist(), ends.tolist())) == e.offsets, t
        assert sum(inside) == sum(1 for b in np.cumsum([0, *(len(coder.bytes_of[i]) for i in e.ids)])[:-1]
                                  if t.encode()[b] & 0xC0 == 0x80)


def test_split_characters_and_broken_bytes(coder, by_ranks):
    ids = by_ranks.encode_ordinary("x😀日")
    shown = coder.shown(ids)
    assert "".join(shown) == "x😀日" and "" in shown
    first = ids[:-1]                                           # ends inside a character
    assert "".join(coder.shown(first)) == coder.raw(first).decode("utf-8", "replace")
    assert "�" in "".join(coder.shown(first))
    with pytest.raises(ValueError, match="not in the vocabulary"):
        coder.raw([10 ** 6])


def test_ranks_without_a_merge_are_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    with pytest.raises(ValueError, match="no merge"):
        byte_bpe.last_pair(b"abc", ranks)


def test_rows(spark, by_ranks):
    rows = [(1, None, "p"), (1, None, "p"), (None, "", "q"), (2, "héllo 😀 wörld", None), (3, "word " * 300_000, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = byte_bpe.encode(df, PATH, PATTERN, offsets=True, decoded=True)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "starts", "ends", "n_split", "decoded"]
    out = got.collect()
    assert len(out) == 5
    for r in out:
        text = r.text or ""
        assert r.ids == by_ranks.encode_ordinary(text) and r.n_tokens == len(r.ids) and bytes(r.decoded).decode() == text
        assert len(r.starts) == len(r.ends) == r.n_tokens
    back = byte_bpe.decode(got.select("doc_id", "ids"), PATH, PATTERN, pieces=True).collect()
    assert sorted(r.decoded for r in back) == sorted((t or "") for _, t, _ in rows)
    assert all("".join(r.pieces) == r.decoded for r in back)
    none = spark.createDataFrame([(None,)], "ids array<int>")
    assert byte_bpe.decode(none, PATH, PATTERN).first().decoded == ""
    assert byte_bpe.encode(df.limit(0), PATH, PATTERN, offsets=True).count() == 0


def test_query_equals_tiktoken(spark, by_ranks):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op12_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = by_ranks.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by_ranks.decode_bytes(ids)).hexdigest()
