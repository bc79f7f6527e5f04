"""Append-only Parquet stores for feedback, usage marks, model runs and run
metrics.

Nothing is updated in place: "mark used" appends (id, run) marks, "insert
or replace" appends a row with a write sequence and readers keep the newest
row per key.  A reader never races a writer on the same files, and a
replayed micro-batch overwrites only its own ``batch_id`` partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..operators.topk import latest_per_key
from ..session import materialize
from . import versions as V
from .files import Files

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("ticket_id", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("subsystem", T.StringType()),
    T.StructField("commitments", T.StringType()),
    T.StructField("predicted_days", T.DoubleType()),
    T.StructField("actual_days", T.DoubleType()),
    T.StructField("delta_pct", T.DoubleType()),
    T.StructField("batch_id", T.LongType()),
])
RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("trigger", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("overrun_recall", T.DoubleType()),
    T.StructField("fold_scores", T.ArrayType(T.DoubleType())),
    T.StructField("seq", T.LongType()),
])


def feedback_rows(requests: DataFrame, batch_id: int | Column = 0) -> DataFrame:
    """Validated feedback requests -> store rows (UTC time, id, signed delta).

    The id is the request's own (``request_id``; the stream readers derive it
    from the file and the row in it).  Without one it is a hash of the batch and
    the content, plus a number for identical requests (counted first, so that a
    request that is a third of the batch is no hot key).  Either way it does not
    depend on how the input is split, so a batch that is replayed with other
    settings keeps its ids and their marks.  Requests with a blank summary or
    without both numbers are left out (see :func:`rejected_feedback`).
    Categories default to 'Unknown', description to ''.
    """
    ok = requests.filter(_acceptable())
    bid = batch_id if isinstance(batch_id, Column) else F.lit(batch_id)
    desc = F.coalesce(F.col("description"), F.lit("")) if "description" in ok.columns else F.lit("")
    cats = {c: (L.default_category(c, empty_is_missing=False) if c in ok.columns else F.lit(L.UNKNOWN))
            for c in L.CATEGORICAL_FEATURES}
    rows = ok.select(
        F.col("summary"), desc.alias("description"), cats["region"].alias("region"),
        cats["subsystem"].alias("subsystem"), cats["commitments"].alias("commitments"),
        F.col("predicted_days").cast("double").alias("predicted_days"),
        F.col("actual_days").cast("double").alias("actual_days"),
        *([F.col("ticket_id").cast("string").alias("ticket_id")] if "ticket_id" in ok.columns
          else [F.lit(None).cast("string").alias("ticket_id")]),
        *([F.col("request_id").cast("string").alias("_request")] if "request_id" in ok.columns else []),
    )
    rows = rows.withColumns({
        "delta_pct": L.delta_pct("predicted_days", "actual_days"),
        "batch_id": bid.cast("long"),
        "created_at": F.current_timestamp(),
    })
    content = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
                                      for c in ["batch_id", "ticket_id", "summary", "description", "region", "subsystem",
                                                "commitments", "predicted_days", "actual_days"]])
    digest = F.sha2(content, 256)
    if "_request" in rows.columns:
        own = F.coalesce(F.col("_request"), digest)
    else:
        rows, own = _numbered(rows.withColumn("_digest", digest)), F.concat_ws("-", "_digest", F.col("_number").cast("string"))
    rows = rows.withColumn("id", F.concat_ws("-", F.col("batch_id").cast("string"), own))
    return rows.select(*FEEDBACK_SCHEMA.fieldNames())


#: Identical requests that one task writes out.
RUN = 10_000


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with a ``_number`` from 1 among identical ones.  Equal rows are
    counted (combined map-side) and come back in runs of bounded length, dealt anew."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    runs = counted.select("*", F.explode(F.expr(f"sequence(1, _n, {RUN})")).alias("_from"))
    return (runs.repartition("_digest", "_from")
            .select(*rows.columns, F.explode(F.expr(f"sequence(_from, least(_from + {RUN - 1}, _n))")).alias("_number")))


def _acceptable() -> Column:
    numbers = [F.col(c).cast("double").isNotNull() for c in ("predicted_days", "actual_days")]
    return F.coalesce(~L.is_blank("summary") & numbers[0] & numbers[1], F.lit(False))


def rejected_feedback(requests: DataFrame) -> DataFrame:
    """The requests that the store does not take, as they came."""
    return requests.filter(~_acceptable())


def append_feedback(requests: DataFrame, path: str, batch_id: int = 0) -> DataFrame:
    """Write one batch (replay-safe: only this batch's partition is replaced);
    rejected requests go to ``<path>_rejected``, the number of rows written to ``<path>_counts``
    (see :func:`feedback_totals`)."""
    spark = requests.sparkSession
    rows = feedback_rows(requests, batch_id)
    bad = rejected_feedback(requests).withColumn("batch_id", F.lit(batch_id).cast("long"))
    held = f"{path}/batch_id={batch_id}"
    Files(spark, held).delete()                          # a replay that has no row any more replaces nothing by itself
    for df, to in ((rows, path), (bad, path + "_rejected")):
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(to))
    n = spark.read.schema(FEEDBACK_SCHEMA).parquet(held).count() if _exists(spark, held) else 0       # from the footers
    (spark.createDataFrame([(n, batch_id)], COUNTS_SCHEMA).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path + "_counts"))
    return rows


COUNTS_SCHEMA = "rows long, batch_id long"


def feedback_totals(spark: SparkSession, path: str, marks_path: str | None = None,
                    threshold: int = L.RETRAIN_THRESHOLD) -> DataFrame:
    """What :func:`feedback_counts` says of the store, without reading its rows:
    the version's counts, the sum of the later batches' counts (one small row per batch),
    and the number of later marks (each id is marked once, so their files' footers have it)."""
    m = V.current(spark, path)
    counts = _table(spark, path + "_counts", COUNTS_SCHEMA).filter(~m.has(F.col("batch_id")))
    total = counts.agg((F.coalesce(F.sum("rows"), F.lit(0)) + m.rows).alias("total"))
    used = m.used + _table(spark, marks_path, MARKS_SCHEMA).filter(~F.col("run_id").isin(m.runs)).count()
    unused = F.col("total") - F.lit(used)
    return total.select("total", unused.alias("unused"), (unused >= threshold).alias("retrain_ready"),
                        F.greatest(F.lit(0).cast("bigint"), F.lit(threshold) - unused).alias("remaining"))


def _exists(spark: SparkSession, path: str) -> bool:
    return Files(spark, path).exists()


MARKS_SCHEMA = "id string, run_id string"


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """Usage marks; none if nothing was written yet.  Marks that are there but
    cannot be read are an error, not an empty table."""
    return _table(spark, path, MARKS_SCHEMA)


def _table(spark: SparkSession, path: str | None, schema) -> DataFrame:
    """A table of the store; empty if nothing was written yet."""
    return spark.read.schema(schema).parquet(path) if path and _exists(spark, path) else spark.createDataFrame([], schema)


def state_of(rows: DataFrame, marks: DataFrame, folded: DataFrame | None = None) -> DataFrame:
    """Feedback rows, and those of a version, ``used`` by the version or by the marks."""
    rows = rows.withColumn("used", F.lit(False))
    if folded is not None:
        rows = folded.unionByName(rows)
    marks = marks.select(F.col("id").alias("_mid")).distinct()
    j = rows.join(marks, rows["id"] == marks["_mid"], "left")
    return j.withColumn("used", F.col("used") | F.col("_mid").isNotNull()).drop("_mid")


def read_feedback(spark: SparkSession, path: str, marks_path: str | None = None) -> DataFrame:
    """Current feedback state: the rows of the last version and of the batches
    since, with ``is_used_for_training`` from the version and from the marks since."""
    m = V.current(spark, path)
    if not m.data:
        rows, folded = spark.read.schema(FEEDBACK_SCHEMA).parquet(path), None
    else:
        rows, folded = _table(spark, path, FEEDBACK_SCHEMA).filter(~m.has(F.col("batch_id"))), V.folded_rows(spark, path, m)
    marks = _table(spark, marks_path, MARKS_SCHEMA).filter(~F.col("run_id").isin(m.runs))
    return state_of(rows, marks, folded).withColumn("is_used_for_training", F.col("used").cast("int")).drop("used")


def mark_used(ids: DataFrame, marks_path: str, run_id: str) -> None:
    """Record that exactly these feedback ids, unused so far, were used by
    ``run_id``.  An id that another run has marked keeps that mark; marking again under
    the same run replaces what an attempt that broke off left."""
    spark = ids.sparkSession
    others = read_marks(spark, marks_path).filter(F.col("run_id") != run_id).select("id")
    new = ids.select(F.col("id").cast("string").alias("id")).distinct().join(others, "id", "left_anti")
    new = materialize(new, "marks")                          # read before this table is written
    (new.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(marks_path))


def unused_rows(fb: DataFrame, flag: str = "is_used_for_training") -> DataFrame:
    """Rows not yet used for training (7 columns)."""
    return fb.filter(F.col(flag) == 0).select("id", "summary", "description", "region", "subsystem",
                                              "commitments", "actual_days")


def evolve(df: DataFrame, defaults: dict) -> DataFrame:
    """Add missing columns with their default (old tables predating a column)."""
    cols = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    out = df.withColumns(cols) if cols else df
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def union_evolved(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """Union of an old-schema and a new-schema table, missing columns filled."""
    return evolve(old.unionByName(new, allowMissingColumns=True), defaults)


def upsert_runs(runs: DataFrame, new: DataFrame, key: str = "run_id", seq: str = "seq") -> DataFrame:
    """Insert or replace by key: the newest write (largest seq) wins."""
    return latest_per_key(runs.unionByName(new, allowMissingColumns=True), [key], [seq])


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    """Append one model run; ``seq`` orders writes for insert-or-replace."""
    row = {f: run.get(f) for f in RUNS_SCHEMA.fieldNames() if f not in ("created_at", "seq")}
    df = spark.createDataFrame([row], T.StructType([f for f in RUNS_SCHEMA.fields
                                                     if f.name not in ("created_at", "seq")]))
    df = df.withColumns({"created_at": F.current_timestamp(),
                         "seq": F.unix_micros(F.current_timestamp())})
    df.select(*RUNS_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Current model runs (one row per run_id, newest write; of writes in the same
    microsecond always the same one)."""
    there = _exists(spark, path)
    raw = spark.read.schema(RUNS_SCHEMA).parquet(path) if there else spark.createDataFrame([], RUNS_SCHEMA)
    tie = F.xxhash64(F.to_json(F.struct(*RUNS_SCHEMA.fieldNames())))
    return latest_per_key(raw.withColumn("_tie", tie), ["run_id"], ["seq", "_tie"]).drop("_tie")


def insert_if_absent(runs: DataFrame, defaults: DataFrame, force: bool = False,
                     key: str = "model_type") -> DataFrame:
    """Add default rows only for model types without any run (all if ``force``)."""
    add = defaults if force else defaults.join(runs.select(key).distinct(), key, "left_anti")
    return runs.unionByName(add, allowMissingColumns=True)


def log_run(spark: SparkSession, path: str, run_id: str, params: dict, metrics: dict, fold_scores: list[float]) -> None:
    """All parameters and metrics of a run in one write, which replaces what a
    broken-off attempt of the same run left.  A parameter that is a text is logged as ``name=text``."""
    rows = [("param", f"{k}={v}", None, 1.0) if isinstance(v, str) else ("param", str(k), None, float(v)) for k, v in params.items()]
    rows += [("metric", f"fold_{k}_score", k, float(v)) for k, v in enumerate(fold_scores)]
    rows += [("metric", str(k), None, float(v) if v is not None else None) for k, v in metrics.items()]
    (spark.createDataFrame(rows, "kind string, name string, step int, value double")
     .withColumns({"logged_at": F.current_timestamp(), "run_id": F.lit(run_id)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def log_metrics(spark: SparkSession, path: str, run_id: str, metrics: dict, step: int | None = None,
                kind: str = "metric") -> None:
    """Append params/metrics of a run as a long table (run_id, kind, name, step, value)."""
    rows = [(run_id, kind, str(k), step, float(v) if v is not None else None) for k, v in metrics.items()]
    schema = "run_id string, kind string, name string, step int, value double"
    (spark.createDataFrame(rows, schema).withColumn("logged_at", F.current_timestamp())
     .write.mode("append").parquet(path))


def write_embeddings(df: DataFrame, path: str, key: str = "ticket_id", vector: str = "embedding",
                     targets=("logged_days", "risk_level"), split: str | None = "split") -> None:
    """Vectors (array<float>) with both targets, keyed by id (no positional files)."""
    cols = [key, F.col(vector).cast("array<float>").alias(vector)] + [c for c in targets if c in df.columns]
    w = df.select(*cols, *([split] if split and split in df.columns else [])).write.mode("overwrite")
    (w.partitionBy(split) if split and split in df.columns else w).parquet(path)


def read_embeddings(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df
