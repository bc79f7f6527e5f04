"""Helpers shared by the training-data operators.

Intermediate tables live in the folder named by ``spark.checkpoint.dir``
(see :func:`effortlab.session.checkpoint_dir`), so a lost executor never
takes the only copy of them, and each is dropped once nothing reads it.
"""

from __future__ import annotations

import ctypes
import os
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir


def by_value(module_name: str) -> None:
    """Ship a module's functions inside the task closure, so executors need
    no installed copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)

#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give back to the system what this worker process has freed: workers
    live on from stage to stage, and so does the memory that they do not use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):                        # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; when it ends, what it held is given
    back (see :func:`trim`), so a worker that waits for its next task holds little."""
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From here on, batches that go to Python hold ``size`` bytes at most (or
    one row).  Whole texts stand in a batch several times, in the JVM, in Arrow
    and as Python strings; by rows alone, long texts make batches of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared
    checkpoint folder."""

    def __init__(self, spark: SparkSession, op: str):
        self.spark = spark
        self.base = os.path.join(checkpoint_dir(spark), "llm", f"{op}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return os.path.join(self.base, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage.  What the write shuffled goes at its end:
        nothing reads it again, and it would stay on the disks until the driver happens to collect garbage."""
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def with_fields(schema: StructType, fields: list[tuple[str, str]]) -> StructType:
    """``schema`` with the fields added; a field of the same name (case does
    not count) is replaced."""
    new = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    taken = {f.name.lower() for f in new}
    return StructType([f for f in schema.fields if f.name.lower() not in taken] + list(new.fields))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Deterministic fold of a row: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labels_of(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The labels of ids that ``docs`` holds: what is gone neither uses up a sample nor
    counts for the share of a class."""
    return labels.join(docs.select(id_col).distinct(), id_col, "left_semi")


def bounded_sample(labels: DataFrame, label: str, per_class: int, *, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` labelled ids of each of the classes 0 and 1, the
    ones with the smallest hashes: a bounded table (2 x per_class rows) that
    does not depend on how the input is partitioned.  Null ids or labels and
    ids labelled both ways carry no information and are left out."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
             .filter("id is not null and y in (0, 1)")
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2"))
    h = F.xxhash64(F.lit(label), "id")
    picked = [known.filter(F.col("y") == c).orderBy(h, "id").limit(per_class) for c in (0, 1)]
    return picked[0].unionByName(picked[1]).select(F.col("id").alias(id_col), "y")
