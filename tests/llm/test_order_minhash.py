"""Order MinHash against a plain Python version; neighbours; odd rows."""

import hashlib
import random
import re

import pytest
import xxhash

from effortlab.llm import order_minhash as om
from effortlab.llm import queries


def h64(raw: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(raw, seed)


def plain_fingerprint(text: str, k: int = om.K) -> list:
    """The least k-mers of every part, in text order; a k-mer's second and further
    occurrences are ordered by a hash of the k-mer's hash and their number."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    seen, numbered = {}, []
    for i in range(len(words)):
        h = h64(words[i].encode())
        for w in words[i + 1:i + k]:
            h = h64(w.encode(), h64(h.to_bytes(8, "little")))
        for _ in range(k - 1 - (len(words[i + 1:i + k]))):
            h = h64(h.to_bytes(8, "little"))
        h = (h & (1 << 63) - 1) >> om._PLACE
        n = seen[h] = seen.get(h, -1) + 1
        if n:
            h = (h64(n.to_bytes(8, "little"), h64(h.to_bytes(8, "little"))) & (1 << 63) - 1) >> om._PLACE
        numbered.append((h >> om._HASH, h & (1 << om._HASH) - 1, i))
    out = []
    for part in range(om.BINS):
        code = 42
        least = sorted(x for x in numbered if x[0] == part)[:om.PER_BIN]
        for _, h, _ in sorted(least, key=lambda x: x[2]):
            code = h64(h.to_bytes(8, "little"), code)
        out.append(f"{code & 0xFFFFFFFF:08x}" if least else "." * 8)
    return out


def plain_likeness(a: list, b: list) -> float:
    filled = [(x, y) for x, y in zip(a, b, strict=True) if x[0] != "." or y[0] != "."]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def check(rows, got):
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    split = lambda s: [s[i:i + 8] for i in range(0, len(s), 8)]
    for (i, t), (_, follows) in zip(order, order[1:] + order[:1], strict=True):
        r, t, follows = by[i], t or "", follows or ""
        edited = t[:len(t) - len(t) // 3] + follows[:len(t) // 3]
        own, other = plain_fingerprint(t), plain_fingerprint(edited)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert split(r.fingerprint) == own and split(r.edited_fingerprint) == other
        assert r.near_edited == pytest.approx(plain_likeness(own, other))
        assert r.near_next == pytest.approx(plain_likeness(own, plain_fingerprint(follows)))


@pytest.mark.parametrize("per_bucket", [100, 3])
def test_equals_plain_version(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(om, "PER_BUCKET", per_bucket)
    rng = random.Random(per_bucket)
    words = [f"w{i}" for i in range(60)] + ["é", "日本", "a b"]
    rows = [(i * i - 50, rng.choice([" ", "\n", " \t "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 30, 200]))))
            for i in range(90)]
    rows += [(-i * i - 60, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 2, 3, 30, 200])))) for i in range(90)]
    rows += [(10**15, None), (10**15 + 1, ""), (-10**15, "x x x x x x x x"), (10**16, "long " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_chars int")
    check(rows, om.edited_and_next(df).collect())


def test_sensitive_to_order_and_edits(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(600)]
    swapped = words[300:] + words[:300]
    edited = words[:500] + [f"v{i}" for i in range(100)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(swapped)), (2, " ".join(edited)), (3, " ".join(words))],
                               "id int, text string")
    f = {r.id: r.f for r in om.with_fingerprint(df, "text", "f").collect()}
    same = lambda a, b: sum(x == y for x, y in zip(f[a], f[b], strict=True)) / om.BINS
    assert same(0, 3) == 1 and same(0, 1) < 0.8 and same(0, 2) > 0.4


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c"), (None, None), (2, None)], "doc_id int, text string")
    got = om.edited_and_next(df).collect()
    assert len(got) == 5 and all(0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert om.edited_and_next(df.limit(0)).count() == 0
    one = om.edited_and_next(df.filter("doc_id = 2")).first()
    assert one.near_next == one.near_edited == 1.0
    assert om.edited_and_next(df.filter("doc_id is null")).count() == 2


def test_query_equals_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op7_order_minhash(spark, sf).collect())


def test_repeats_count(spark):
    """A passage 2 or 200 times is not the same text; numbered as in plain Python."""
    rng = random.Random(3)
    head, line = " ".join(f"h{rng.randrange(10**6)}" for _ in range(300)), " ".join(f"l{i}" for i in range(60))
    texts = [f"{head} " + f"{line} " * 2, f"{head} " + f"{line} " * 200, "long " * 5, "long " * 20_000, "", "a", "a a", "a b a b a b a b",
             *(" ".join(rng.choice("abcd") for _ in range(rng.randrange(300))) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = om.with_fingerprint(df, "text", "f").select("id", "f", om.as_string("f").alias("s")).collect()
    shown = {r.id: [r.s[i:i + 8] for i in range(0, len(r.s), 8)] for r in rows}
    assert all(shown[i] == plain_fingerprint(t) for i, t in enumerate(texts))
    assert plain_likeness(shown[0], shown[1]) < 0.2 and plain_likeness(shown[2], shown[3]) < 0.2
