"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts are a group that stays together.  Groups, largest
first, enter the bin with the least room that still holds them; a balanced tree
of the bins' remaining room finds it.  The number of shards is fixed, so the
capacity is the smallest at which the packing needs no more shards than there are:
the shards' bytes come out near equal.

At scale no task sees all groups.  Groups under a ``grain`` (total bytes /
shards / ``GRAINS``) are dealt into lots by their key's hash, and each lot packs its
own into bricks of a grain by the same rule.  At most one brick of a lot is not half
full; while there are more lots than shards x GRAINS, the bricks are dealt into lots
and packed again.  What is left to pack, bricks and large groups, is bounded by shards x
GRAINS, whatever the number of groups.
A group larger than a shard cannot stay whole; its rows are dealt into pieces of at most
a shard, so equal texts of a third of all rows break nothing.  Groups with many rows
(over 1 / (shards x GRAINS) of all) are placed by a broadcast of bounded size, so no
shuffle meets their key.

Positions inside a shard are counted per bucket of a hash of id and checksum and offset
by the buckets' totals, so no task numbers a whole shard, nor all rows without an id.

Defined results: a null text has no bytes and is a group of its own, apart from the
empty text (its checksum is that of no bytes).  Every row gets a place, repeated ids
too; positions order by id, then checksum, within a bucket.  Rows are never moved by
text; extra columns pass through, columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_value

by_value(__name__)

#: Grains per shard, groups per lot and rows per numbering bucket.
GRAINS, PER_LOT, PER_BUCKET = 64, 50_000, 50_000


class RoomTree:
    """Balanced (AVL) search tree of (room, bin); finds the least room that is
    enough."""

    def __init__(self):
        self.root = None                              # node: [key, left, right, height]

    @staticmethod
    def _height(n) -> int:
        return n[3] if n else 0

    def _fix(self, n):
        h = self._height
        n[3] = 1 + max(h(n[1]), h(n[2]))
        for a, b in ((1, 2), (2, 1)):                 # side a is too high: rotate it up
            if h(n[a]) > h(n[b]) + 1:
                c = n[a]
                if h(c[b]) > h(c[a]):
                    n[a] = self._rotate(c, b, a)
                return self._rotate(n, a, b)
        return n

    def _rotate(self, n, a: int, b: int):
        c = n[a]
        n[a], c[b] = c[b], n
        for x in (n, c):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return c

    def add(self, key: tuple[int, int]) -> None:
        def into(n):
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = into(n[side])
            return self._fix(n)
        self.root = into(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def out_of(n, key):
            if key != n[0]:
                side = 1 if key < n[0] else 2
                n[side] = out_of(n[side], key)
            elif n[1] is None or n[2] is None:
                return n[1] or n[2]
            else:
                low = n[2]
                while low[1]:
                    low = low[1]
                n[0] = low[0]
                n[2] = out_of(n[2], low[0])
            return self._fix(n)
        self.root = out_of(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[1]
            else:
                n = n[2]
        return best


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each item (given in decreasing size) and the number of bins."""
    tree, out, bins = RoomTree(), [], 0
    for s in sizes:
        found = tree.tightest(s)
        if found:
            tree.remove(found)
            room, b = found
        else:
            room, b, bins = capacity, bins, bins + 1
        tree.add((room - s, b))
        out.append(b)
    return out, bins


def pack(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item (decreasing sizes), at the smallest capacity (to one
    part in 2^20 of a shard) at which ``shards`` bins are enough."""
    total = sum(sizes)
    low = max([-(-total // shards), *sizes[:1]])
    high, best = low, None
    while best is None:                               # a capacity that does
        got, bins = best_fit(sizes, high)
        if bins <= shards:
            best = got
        else:
            high += max(1, low >> 6)
    step = max(1, low >> 20)
    while high - low > step:
        mid = (low + high) // 2
        got, bins = best_fit(sizes, mid)
        if bins <= shards:
            best, high = got, mid
        else:
            low = mid
    return best


def _bricks(small: DataFrame, grain: int) -> DataFrame:
    """key, lot, brick, size: small groups packed into bricks, lot by lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, tree, bricks = None, RoomTree(), 0
        for batch in batches:
            out = []
            for of, size in zip(batch.column("lot").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if of != lot:
                    lot, tree, bricks = of, RoomTree(), 0
                found = tree.tightest(size)
                if found:
                    tree.remove(found)
                    room, b = found
                else:
                    room, b, bricks = grain, bricks, bricks + 1
                if room > size:
                    tree.add((room - size, b))
                out.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lot"), pa.array(out, pa.int64()),
                                              batch.column("size")], ["key", "lot", "brick", "size"])

    return (small.repartition("lot").sortWithinPartitions("lot", F.desc("size"), "key").select("key", "lot", "size")
            .mapInArrow(run, "key binary, lot bigint, brick bigint, size bigint"))


def shard(docs: DataFrame, shards: int = 40, *, text: str = "text", id_col: str = "doc_id", overhead: int = 16) -> DataFrame:
    """``docs`` without the text, with ``size``, ``text_crc32``, ``law``,
    ``shard``, ``slot`` and ``grown_shard`` (null under the law ``bytes``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    results = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    passed = [c for c in docs.columns if c not in (text, id_col) and c.lower() not in results]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = scratch.put(docs.select(
        F.col(id_col).alias("__id"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(passed)],
        (F.octet_length(body) + overhead).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
        F.unhex(F.when(F.col(text).isNull(), F.lit("00")).otherwise(F.sha2(body, 256))).alias("key")), "rows")
    groups = scratch.put(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("held")), "groups")
    sums = groups.agg(F.sum("size").alias("size"), F.sum("held").alias("held"), F.count("*").alias("groups")).first()
    total, n = sums["size"] or 0, sums["held"] or 0
    full, grain = max(1, -(-total // shards)), max(1, total // (shards * GRAINS))
    lots = max(1, min(shards, sums["groups"] // 1000), sums["groups"] // PER_LOT)

    # Large groups and bricks: bounded tables that one driver step packs.
    many = max(1, n // (shards * GRAINS))
    is_large = (F.col("size") >= grain) | (F.col("held") > many)
    large = groups.filter(is_large).withColumn(
        "pieces", F.when(F.col("size") <= full, F.lit(1)).otherwise(F.ceil(F.col("size") * 2 / F.lit(full))))
    bricks = scratch.put(_bricks(groups.filter(~is_large).withColumn(
        "lot", F.expr(f"pmod(xxhash64(key), {lots}L)")), grain), "bricks")
    of_group = bricks.select("key", "lot", "brick")
    while lots > shards * GRAINS:                        # open bricks of the lots are packed again
        lots, before = -(-(2 * shards * GRAINS + lots) // PER_LOT), lots
        if lots >= before:
            break
        name = F.concat_ws(":", "lot", "brick").cast("binary")
        sums = bricks.groupBy(name.alias("key")).agg(F.sum("size").alias("size"))
        bricks = scratch.put(_bricks(sums.withColumn("lot", F.expr(f"pmod(xxhash64(key), {lots}L)")), grain), f"bricks-{lots}")
        of_group = (of_group.select("key", name.alias("__brick"))
                    .join(bricks.select(F.col("key").alias("__brick"), "lot", "brick"), "__brick").select("key", "lot", "brick"))
    pieces = (rows.join(F.broadcast(large.select("key", "pieces")), "key")          # at most 2 x shards x GRAINS keys
              .withColumn("piece", F.expr("pmod(xxhash64(__id, text_crc32), pieces)"))
              .groupBy("key", "piece").agg(F.sum("size").alias("size")))
    items = pd.concat([
        pieces.toPandas().assign(lot=-1, brick=-1),
        bricks.groupBy("lot", "brick").agg(F.sum("size").alias("size")).toPandas().assign(key=None, piece=-1)])
    items["order"] = items["key"].map(lambda k: bytes(k) if k is not None else b"")
    items = items.sort_values(["size", "order", "piece", "lot", "brick"], ascending=[False, True, True, True, True])
    placed = pack([int(s) for s in items["size"]], shards) if len(items) else []
    items = items.assign(shard=placed)
    whole = items[items["lot"] < 0]
    packed = items[items["lot"] >= 0]
    of_piece = spark.createDataFrame(
        [(bytes(k), int(p), int(s)) for k, p, s in zip(whole["key"], whole["piece"], whole["shard"], strict=True)],
        "key binary, piece bigint, shard int")
    of_brick = spark.createDataFrame(
        [(int(a), int(b), int(s)) for a, b, s in zip(packed["lot"], packed["brick"], packed["shard"], strict=True)],
        "lot bigint, brick bigint, shard int")
    of_group = of_group.join(F.broadcast(of_brick), ["lot", "brick"]).select("key", "shard")
    per_key = F.broadcast(large.select("key", "pieces"))
    hot = (rows.join(per_key, "key").withColumn("piece", F.expr("pmod(xxhash64(__id, text_crc32), pieces)"))
           .join(F.broadcast(of_piece), ["key", "piece"]).drop("pieces", "piece"))
    rest = rows.join(per_key, "key", "left_anti").join(of_group, "key")
    buckets = max(1, n // (shards * PER_BUCKET))
    placed = scratch.put(hot.unionByName(rest).drop("key").withColumn(
        "bucket", F.expr(f"pmod(xxhash64(__id, text_crc32), {buckets}L)")), "placed")

    # Slots: counts per (shard, bucket) give each bucket its first slot.
    first = placed.groupBy("shard", "bucket").agg(F.count("*").alias("held"))
    first = first.select("shard", "bucket", (F.sum("held").over(Window.partitionBy("shard").orderBy("bucket"))
                                             - F.col("held")).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("__id", "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(inside)).join(first, ["shard", "bucket"])
    return numbered.select(
        F.col("__id").alias(id_col), *[F.col(f"__p{i}").alias(c) for i, c in enumerate(passed)], "size", "text_crc32",
        F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
