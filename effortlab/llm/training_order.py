"""Token-id output in training order.

Token streams are cut into sequences of ``length`` ids, and a keyed Feistel
permutation with cycle-walking gives each sequence its global slot: a shuffle of the
whole corpus that needs no random numbers, no sort key and no state, and whose
inverse tells which sequence stands at a slot.  Slots are partitioned by range, and
each range of ``per_shard`` slots is one binary shard of records with a fixed stride.
The record of slot s starts at byte ``(s % per_shard) * stride`` of shard
``s // per_shard``, so a reader can resume anywhere without an index.

A record is: slot (8 bytes), number of ids (4), crc32 of the ids (4), the ids as
unsigned 16-bit integers filled up with the end token, one line feed; all little
endian.  Shards are written by Spark's own writer and committer, so a task that is
lost or runs twice leaves no half shard.  Beside them stands a manifest (Parquet):
slot, shard, offset, number of ids, and the ids of the documents it has text of.

Sequences are cut from documents in the order in which they are scanned, each
document closed by the end token, without a shuffle; the cut sequences are written
once, and a sequence's number is its file's first number plus its row there, so a
recomputed task cannot renumber anything.  Only sequences move, once, compressed with
a dictionary made from a few hundred of them.

Defined results: null and empty texts are a single end token.  Repeated rows and ids are
written each.  An empty table has no shards.  Texts are read whole; a long text
fills as many sequences as it needs.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_value

by_value(__name__)

HEADER = np.dtype([("slot", "<i8"), ("n", "<u4"), ("crc", "<u4")])
ROUNDS = 6
#: Files of cut sequences up to which their first numbers are broadcast.
SMALL = 200_000


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int, *, inverse: bool = False) -> np.ndarray:
    """Slots of the indices 0 .. n-1 under a keyed bijection of that range (or the
    indices of the slots).  A balanced Feistel network permutes the next even power
    of two; a value that falls outside the range is sent through again."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    rounds = range(ROUNDS)
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in reversed(rounds) if inverse else rounds:
            if inverse:
                left, right = right ^ (_mix(left, key * 1_000_003 + r) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key * 1_000_003 + r) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def stride(length: int) -> int:
    return HEADER.itemsize + 2 * length + 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _cut(docs: DataFrame, ranks: dict[bytes, int], pattern: str, end: int, length: int) -> DataFrame:
    """doc_ids, n, ids: sequences cut from the documents as they are scanned."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))            # the vocabulary: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        open_, owners, done = np.empty(0, np.uint16), [], []

        def pack(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([len(r[1]) for r in rows], pa.int32()),
                 pa.array([r[1].tobytes() for r in rows], pa.binary())], ["doc_ids", "n", "ids"])

        for batch in batches:
            if coder is None:
                coder = tiktoken.Encoding("ranks", pat_str=shared.value[1], mergeable_ranks=shared.value[0], special_tokens={})
            for doc, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                new = np.array([*coder.encode_ordinary(t or ""), end], np.uint16)
                at = 0
                while at < len(new):
                    take = min(length - len(open_), len(new) - at)
                    open_, at = np.concatenate([open_, new[at:at + take]]), at + take
                    if doc is not None and (not owners or owners[-1] != doc):
                        owners.append(doc)
                    if len(open_) == length:
                        done.append((owners, open_))
                        open_, owners = np.empty(0, np.uint16), []
                        if len(done) == 512:
                            yield pack(done)
                            done = []
        if len(open_):
            done.append((owners, open_))
        if done:
            yield pack(done)

    return docs.mapInArrow(run, "doc_ids array<bigint>, n int, ids binary")


def _dictionary(cut: DataFrame) -> bytes:
    """Compression dictionary from at most 300 sequences; none if there are few."""
    seen = [r["ids"] for r in cut.select("ids").limit(300).collect()]
    try:
        return zstandard.train_dictionary(131_072, [bytes(x) for x in seen]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _slots(seqs: DataFrame, total: int, key: int, per_shard: int, dictionary: bytes) -> DataFrame:
    """index, ids -> slot, shard and the compressed ids: what is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            slot = permute(batch.column("index").to_numpy(), total, key)
            packed = [coder.compress(raw) for raw in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array(packed, pa.binary())],
                                             ["slot", "shard", "packed"])

    return seqs.select("index", "ids").mapInArrow(run, "slot bigint, shard bigint, packed binary")


def _records(slots: DataFrame, length: int, end: int, dictionary: bytes) -> DataFrame:
    """slot, shard, compressed ids -> slot, shard and the record as it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch, out = whole.slice(lo, 1024), []
                for s, packed in zip(batch.column("slot").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                    raw = coder.decompress(packed)
                    head = np.array([(s, len(raw) // 2, zlib.crc32(raw))], HEADER).tobytes()
                    out.append(head + raw + np.full(length - len(raw) // 2, end, "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("shard"), pa.array(out, pa.binary())],
                                                 ["slot", "shard", "record"])

    return slots.mapInArrow(run, "slot bigint, shard bigint, record binary")


def write(docs: DataFrame, path: str, vocabulary: str, pattern: str, *, key: int = 20_240_229, length: int = 2048,
          per_shard: int = 4096, end: int = 50256, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the shards to ``path``/shards and return the manifest, which stands in
    ``path``/manifest."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "training-order")
    ranks = load_ranks(vocabulary)
    if max(end, *ranks.values()) >= 1 << 16:
        raise ValueError("ids do not fit 16 bits")
    cut = _cut(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")), ranks, pattern, end, length)
    cut.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(scratch.path("cut"))
    cut = spark.read.schema(cut.schema).parquet(scratch.path("cut")).select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = cut.groupBy("file").agg(F.count("*").alias("held"))
    first = scratch.put(files.select("file", (F.sum("held").over(Window.orderBy("file")) - F.col("held")).alias("before"),
                                     "held"), "files")                    # a row per file
    total = first.agg(F.sum("held")).first()[0] or 0
    numbered = cut.join(F.broadcast(first) if first.count() <= SMALL else first, "file").withColumn(
        "index", F.col("before") + F.col("row"))
    shards = max(1, -(-total // per_shard))
    dictionary = _dictionary(cut)
    moved = _slots(numbered, total, key, per_shard, dictionary).repartitionByRange(shards, "shard")
    (_records(moved, length, end, dictionary)
     .sortWithinPartitions("shard", "slot").select(F.col("record").cast("string").alias("value"), "shard")
     .write.partitionBy("shard").option("lineSep", "\n").text(f"{path}/shards"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column("index").to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column("n"), batch.column("doc_ids")],
                                             ["slot", "n_tokens", "doc_ids"])

    manifest = numbered.select("index", "n", "doc_ids").mapInArrow(entries, "slot bigint, n_tokens int, doc_ids array<bigint>")
    manifest.select("slot", F.expr(f"slot div {per_shard}").alias("shard"),
                    (F.col("slot") % per_shard * stride(length)).alias("offset"), "n_tokens", "doc_ids"
                    ).write.parquet(f"{path}/manifest")
    scratch.drop("cut", "files")
    return spark.read.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, *, first: int = 0, last: int | None = None, length: int = 2048,
         per_shard: int = 4096) -> DataFrame:
    """slot, shard, offset, n_tokens, crc32, ids of the slots from ``first`` up to (not
    including) ``last``, read from the shards; only the shards of the range are opened."""
    size = stride(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
                begin = max(0, first - shard * per_shard)
                stop = len(raw) // size if last is None else min(len(raw) // size, last - shard * per_shard)
                for lo in range(begin, stop, 512):
                    rows = []
                    for i in range(lo, min(stop, lo + 512)):
                        head = np.frombuffer(raw, HEADER, 1, i * size)[0]
                        ids = raw[(at := i * size + HEADER.itemsize):at + 2 * int(head["n"])]
                        if head["slot"] != shard * per_shard + i or zlib.crc32(ids) != head["crc"]:
                            raise ValueError(f"record {i} of shard {shard} is damaged")
                        rows.append((int(head["slot"]), shard, i * size, int(head["n"]), int(head["crc"]), ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), (
                            pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                        ["slot", "shard", "offset", "n_tokens", "crc32", "ids"])

    out = "slot bigint, shard bigint, offset bigint, n_tokens int, crc32 bigint, ids binary"
    files = spark.read.format("binaryFile").load(f"{path}/shards")
    if "shard" not in files.columns:                                     # nothing was written
        return spark.createDataFrame([], out)
    files = files.select(F.col("shard").cast("bigint"), "content")
    files = files.filter(F.col("shard") >= first // per_shard)
    if last is not None:
        files = files.filter(F.col("shard") <= (last - 1) // per_shard)
    return files.mapInArrow(run, out)
