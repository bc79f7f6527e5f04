"""Best-fit packing against a plain version; places of all rows."""

import random
import zlib

import pytest

from effortlab.llm import sharding


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            i = min(fits)[1]
        else:
            rooms.append(capacity)
            i = len(rooms) - 1
        rooms[i] -= s
        out.append(i)
    return out, len(rooms)


def test_tree_packing_equals_plain_packing():
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted((rng.randint(0, 50) for _ in range(rng.randint(0, 150))), reverse=True)
        capacity = max([60, *sizes])
        assert sharding.best_fit(sizes, capacity) == plain_best_fit(sizes, capacity)


def test_tree_stays_balanced():
    tree = sharding.RoomTree()
    for i in range(2000):
        tree.add((i, i))
    for i in range(0, 2000, 3):
        tree.remove((i, i))
    assert tree.root[3] <= 13 and tree.tightest(300) == (301, 301) and tree.tightest(1999) == (1999, 1999)
    assert tree.tightest(2000) is None


def test_shards_are_near_equal_and_few():
    rng = random.Random(2)
    sizes = sorted((int(rng.lognormvariate(7, 1)) + 1 for _ in range(3000)), reverse=True)
    got = sharding.pack(sizes, 40)
    load = [0] * 40
    for s, b in zip(sizes, got, strict=True):
        load[b] += s
    assert max(load) <= 1.001 * sum(sizes) / 40 and min(load) >= 0.95 * sum(sizes) / 40


@pytest.mark.parametrize("hot", ["big", "tiny"])
def test_every_row_gets_a_place(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "PER_BUCKET", 20)
    monkeypatch.setattr(sharding, "PER_LOT", 50)
    rng = random.Random(hot)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 300))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i % 40]) for i in range(120)]
    rows += [(2000 + i, "h" * 400 if hot == "big" else "") for i in range(400)] + [(5000 + i, None) for i in range(30)]
    rows += [(7, texts[7]), (None, "no id"), (9000, "z" * 9_000)]
    df = spark.createDataFrame([(*r, r[0], "x") for r in rows], "doc_id bigint, text string, size int, extra string")
    out = sharding.shard(df, 10)
    assert out.columns == ["doc_id", "extra", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    total = sum(r.size for r in got)
    load, of = {}, {}
    for r in got:
        load.setdefault(r.shard, []).append(r)
        of.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert set(load) <= set(range(10)) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for held in load.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert abs(sum(r.size for r in held) - total / 10) < 0.02 * total / 10
    split = {k for k, v in of.items() if len(v) > 1}
    assert len(split) <= (hot == "big") + 1                 # the hot group; null and empty texts share a checksum
    assert sharding.shard(df.limit(0), 10).count() == 0


def test_what_the_driver_packs_is_bounded(spark, monkeypatch):
    """Ten times the groups, the same number of items: the lots' open bricks are packed again."""
    monkeypatch.setattr(sharding, "PER_LOT", 4)
    monkeypatch.setattr(sharding, "GRAINS", 2)
    packed, pack = [], sharding.pack
    monkeypatch.setattr(sharding, "pack", lambda sizes, shards: packed.append(len(sizes)) or pack(sizes, shards))
    rng = random.Random(3)
    for n in (300, 3000):
        rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 60)))) for i in range(n)]
        got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).collect()
        assert sorted(r.doc_id for r in got) == list(range(n))
        load = {}
        for r in got:
            load[r.shard] = load.get(r.shard, 0) + r.size
        assert len(load) == 5 and max(load.values()) < 1.25 * sum(load.values()) / 5
    assert max(packed) <= 4 * 5 * 2


def test_query_places_every_document(spark):
    """The registered query on 40 shards: bytes near equal, slots without gaps, equal texts together."""
    from effortlab.llm import queries
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_sharding_bfd(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    load, of = {}, {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        load.setdefault(r.shard, []).append(r)
        of.setdefault(raw, set()).add(r.shard)
    mean = sum(r.size for r in got) / 40
    whole = max(r.size for r in got) <= mean
    assert set(load) == set(range(40)) and all(len(s) == 1 for t, s in of.items() if len(t) <= mean)
    for held in load.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert not whole or abs(sum(r.size for r in held) - mean) < 0.05 * mean
