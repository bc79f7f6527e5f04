"""Records of quoted CSV files, cut in parallel.

A line feed ends a record unless it stands inside quotes, and whether it does
depends on everything before it in the file.  Two passes over the splits of
the files make that a local question.  The first pass reads each split under
both assumptions, that it begins outside of quotes and that it begins inside,
and keeps what follows from either: how it ends, and whether a record begins
in it.  Running these small facts along a file tells every split which
assumption holds, and in which split a record that is open at its beginning
began.  The second pass cuts the records.  One that lies in several splits
leaves each as a fragment under the split in which it began, and only such
fragments are shuffled.

The rules are those of Spark's CSV reader: a field is quoted if it begins with
a quote; inside, a doubled quote is a quote; after the closing quote
anything up to the next comma belongs to the field.  A quote inside of an
unquoted field means nothing.  Blank lines between records are skipped, and a
carriage return before the line feed that ends a record is no part of it.
Lines end at line feeds.  A quote that is never closed makes one record of the
rest of its file, as it does there.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# One field: quoted (group 1: its closing quote, empty if the line ends inside) or bare.
_FIELD = re.compile(rb'"[^"]*+(?:""[^"]*+)*+("?+)[^,]*+|[^,]*+')
BLANK = (b"", b"\r")


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside (or outside) of quotes ends inside."""
    if b'"' not in line:
        return inside
    if inside:
        line = b'"' + line                       # goes on with a quoted field
    at = 0
    while True:
        field = _FIELD.match(line, at)
        at = field.end()
        if at >= len(line):
            return field.group(1) == b""
        at += 1                                  # the comma


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): the physical lines with the split they were read in."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.col("value").cast("binary").alias("line")))


def _by_split(batches: Iterator[pa.RecordBatch], *more: str):
    """Rows of the batches as (file, start, ..., line); lines of a split stand together."""
    for batch in batches:
        cols = [batch.column(c) for c in ("file", "start", *more)]
        yield from zip(*[c.to_pylist() for c in cols], batch.column("line").to_pylist())


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: how it ends and whether a record begins in it, if it begins
    outside (0) or inside (1) of quotes."""
    names = ["file", "start", "end0", "begins0", "end1", "begins1"]

    def row(key, ends, begins):
        return pa.RecordBatch.from_pydict(dict(zip(names, [[key[0]], [key[1]], [ends[0]], [begins[0]], [ends[1]], [begins[1]]])))

    key, ends, begins = None, [], []
    for file, start, line in _by_split(batches):
        if key != (file, start):
            if key:
                yield row(key, ends, begins)
            key, ends, begins = (file, start), [False, True], [False, False]
        for k in (0, 1):
            begins[k] = begins[k] or (not ends[k] and line not in BLANK)
            ends[k] = ends_inside(line, ends[k])
    if key:
        yield row(key, ends, begins)


def splits(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, inside, owner, header): whether a split begins inside of
    quotes, the split in which the record that is open there began, and whether
    the file's header begins in it.  One small row per split."""
    facts = _lines(spark, path).mapInArrow(_facts, "file bigint, start bigint, end0 boolean, begins0 boolean, end1 boolean, begins1 boolean")
    along = Window.partitionBy("file").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # A split that ends alike under both assumptions settles the state; the others keep or turn it.
    settled = F.when(F.col("end0") == F.col("end1"), F.col("end0").cast("int"))
    turned = F.when(F.col("end0") & ~F.col("end1"), 1).otherwise(0)
    stretch = facts.withColumns({"settled": settled, "turned": turned}).withColumn(
        "stretch", F.coalesce(F.sum(F.when(F.col("settled").isNotNull(), 1).otherwise(0)).over(before), F.lit(0)))
    within = Window.partitionBy("file", "stretch").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.last("settled", ignorenulls=True).over(before), F.lit(0))
    known = stretch.withColumn("inside", (base + F.coalesce(F.sum("turned").over(within), F.lit(0))) % 2 == 1)
    open_here = F.when(F.col("inside"), F.col("end1") & F.col("begins1")).otherwise(F.col("end0") & F.col("begins0"))
    return known.select(
        "file", "start", "inside",
        F.last(F.when(open_here, F.col("start")), ignorenulls=True).over(before).alias("owner"),
        F.coalesce(F.col("start") == F.min(F.when(F.col("begins0"), F.col("start"))).over(Window.partitionBy("file")),
                   F.lit(False)).alias("header"))


def _cut(skip_header: bool):
    """Whole records, and the fragments of those that cross a border."""
    kinds = {"record": pa.binary(), "file": pa.int64(), "owner": pa.int64(), "start": pa.int64(), "header": pa.bool_()}

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        key = owner = None
        held: list[bytes] = []                   # lines of the open record
        inside = inherited = header = False

        def close(whole: bool) -> None:
            nonlocal header, size
            text = b"\n".join(held)
            # A fragment that another one follows keeps the line feed between them.
            text = (text[:-1] if text.endswith(b"\r") else text) if whole else text + b"\n"
            first = header and not inherited
            if inherited:
                out.append((text, key[0], owner, key[1], False))
            elif not whole:
                out.append((text, key[0], key[1], key[1], first))
            elif not (first and skip_header):
                out.append((text, None, None, None, None))
            if first:
                header = False
            size += len(text)
            held.clear()

        for file, start, begins_inside, begun, has_header, line in _by_split(batches, "inside", "owner", "header"):
            if key != (file, start):
                if held:
                    close(False)
                key, owner, header = (file, start), begun, has_header
                inside = inherited = begins_inside
            if not inside and not held and line in BLANK:
                continue
            held.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                close(True)
                inherited = False
            if size > 4_000_000:
                yield rows(out)
                out, size = [], 0
        if held:
            close(False)
        yield rows(out)

    return run


def records(spark: SparkSession, path: str, skip_header: bool = True) -> DataFrame:
    """(record): every record of the files under ``path`` as text, without
    the header of each file.  No task reads more than its splits, and only
    records that cross a border of splits move."""
    state = splits(spark, path)
    lines = _lines(spark, path).withColumn("place", F.monotonically_increasing_id())
    # Adaptive execution chooses the join by the size of the table of splits.
    known = lines.join(state, ["file", "start"]).sortWithinPartitions("file", "start", "place")
    parts = known.select("file", "start", "inside", "owner", "header", "line").mapInArrow(
        _cut(skip_header), "record binary, file bigint, owner bigint, start bigint, header boolean")
    whole = parts.filter("file is null").select("record")
    # The last fragment of a record ends without a line feed; one that the end of the file cuts off has it too much.
    crossing = (parts.filter("file is not null").groupBy("file", "owner")
                .agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"), F.max("header").alias("header")))
    if skip_header:
        crossing = crossing.filter(~F.col("header"))
    joined = F.aggregate("parts.record", F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    return whole.unionByName(crossing.select(joined.alias("record"))).select(F.col("record").cast("string").alias("record"))
