"""Readers for the driver's Parquet tables and the derived views used as
work-item data (``tickets``), raw option literals, feedback, fold
predictions and model runs.  Everything is a lazy DataFrame over the given
tables, so its size grows with them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import delta_pct

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tickets(spark: SparkSession, sf_dir: str, fill_description: bool = True, documents: bool = True) -> DataFrame:
    """One work item per order.

    summary = 'T-<key> <customer>', description = document text (if any),
    time_spent = floor(totalprice / 2) seconds, estimate (story points) from
    the priority digit, null for pending orders; region / subsystem /
    commitments from customer region, region/nation and market segment.
    nation and region are tiny dimension tables (25 / 5 rows): Spark
    broadcasts them by size.  The document text is joined only with
    ``documents``: Spark cannot drop that join by itself for callers that do
    not read the description (it does not know ``doc_id`` to be unique).
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    if documents:
        d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
        # Texts are no broadcast table: they grow, and text work belongs in as many tasks as there are texts.
        j = j.join(d.hint("merge"), o.o_orderkey == d.doc_id, "left")
    else:
        j = j.withColumn("text", F.lit(None).cast("string"))
    estimate = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("double")).otherwise(
        (F.substring("o_orderpriority", 1, 1).cast("int") * 3 - 3).cast("double"))
    return j.select(
        F.col("o_orderkey").alias("ticket_id"),
        F.concat(F.lit("T-"), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("c_name")).alias("summary"),
        (F.coalesce(F.col("text"), F.lit("")) if fill_description else F.col("text")).alias("description"),
        F.floor(F.col("o_totalprice") / 2).cast("bigint").alias("time_spent"),
        estimate.alias("estimate"),
        F.col("r_name").alias("region"),
        F.concat(F.col("r_name"), F.lit("/"), F.col("n_name")).alias("subsystem"),
        F.col("c_mktsegment").alias("commitments"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "In Progress")
         .otherwise("Open").alias("status"),
    )


def _raw_options():
    """Option fields of a ticket rendered as Python-literal text."""
    tid = F.col("ticket_id")
    q = F.lit("'")
    region_raw = (F.when(tid % 5 == 0, F.lit(None).cast("string"))
                  .when(tid % 5 == 1, F.lit("[]"))
                  .when(tid % 5 == 2, F.concat(F.lit("[{'value': '"), F.col("region"), F.lit("'}, {'value': 'ALL'}]")))
                  .otherwise(F.concat(F.lit("[{'value': '"), F.col("region"), F.lit("'}]"))))
    subsystem_raw = (F.when(tid % 4 == 0, F.lit("oops"))
                     .when(tid % 4 == 1, F.concat(F.lit("{'value': '"), F.col("region"), q, F.lit("}")))
                     .otherwise(F.concat(F.lit("{'value': '"), F.col("region"), F.lit("', 'child': {'value': '"),
                                         F.col("subsystem"), F.lit("'}}"))))
    commitments_raw = (F.when(tid % 3 == 0, F.lit("[1]"))
                       .otherwise(F.concat(F.lit("{'value': '"), F.col("commitments"), F.lit("'}"))))
    # Some are spelt as literals may be: tabs, escapes, nesting, trailing commas; some are long.
    odd, long = tid % 50 == 7, tid % 50 == 13
    region_raw = (F.when(odd, F.concat(F.lit("\t[{'value': 'it\\'s ] "), F.col("region"), F.lit("', 'tags': [{'a': [1, None, (2,)]}]},]")))
                  .when(long, F.concat(F.lit("[{'value': '" + "x" * 5000), F.col("region"), F.lit("'}]"))).otherwise(region_raw))
    subsystem_raw = (F.when(odd, F.concat(F.lit("{'value': \""), F.col("region"), F.lit("\", 'child': {'value': 'B\\x41', 'x': {'y': 1}}}")))
                     .when(long, F.concat(F.lit("{'child': {'value': {'deep': [[[]]]}, 'value': '"), F.col("subsystem"), F.lit("//'}, 'value': 'S'}")))
                     .otherwise(subsystem_raw))
    commitments_raw = (F.when(odd, F.concat(F.lit("{'value': '"), F.col("commitments"), F.lit("\\u00e9' '!', 'n': None}")))
                       .when(long, F.concat(F.lit("{'all': [" + "[], " * 1500 + "], 'value': '"), F.col("commitments"), F.lit("'}")))
                       .otherwise(commitments_raw))
    return region_raw, subsystem_raw, commitments_raw


def tickets_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option fields as literal text, as in an issue export CSV."""
    region, subsystem, commitments = _raw_options()
    return tickets(spark, sf_dir, documents=False).select(
        "ticket_id", region.alias("region_raw"), subsystem.alias("subsystem_raw"), commitments.alias("commitments_raw"))


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export-shaped seed table: tickets with the option fields as literals."""
    region, subsystem, commitments = _raw_options()
    return tickets(spark, sf_dir).withColumns({"region": region, "subsystem": subsystem, "commitments": commitments})


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback store content derived from ``events`` (includes zero actuals)."""
    e = read_table(spark, sf_dir, "events")
    actual = F.when(F.col("event_id") % 97 == 0, F.lit(0.0)).otherwise(F.col("value") / 10)
    out = e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("Event "), F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string")).alias("summary"),
        F.coalesce(F.col("props"), F.lit("")).alias("description"),
        F.lit("Unknown").alias("region"),
        F.concat(F.lit("users/"), (F.col("user_id") % 10).cast("string")).alias("subsystem"),
        F.col("event_type").alias("commitments"),
        (F.floor(F.col("value") / 50) * 5 + 2.5).alias("predicted_days"),
        actual.alias("actual_days"),
        F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).cast("int").alias("is_used_for_training"),
    )
    return out.withColumn("delta_pct", delta_pct("predicted_days", "actual_days"))


N_FOLDS = 5


def with_fold_predictions(ds: DataFrame) -> DataFrame:
    """Add ``pred_log_k`` and fold class probabilities ``p{c}_k``: exact
    functions of the ticket, so every metric over them has an exact oracle."""
    tid = F.col("ticket_id")
    cols = {}
    for k in range(N_FOLDS):
        cols[f"pred_log_{k}"] = (F.log1p(F.col("estimate") / 2) * (0.8 + 0.1 * k)
                                 + (tid % 11).cast("double") / 40.0)
        p2 = ((tid + k) % 10).cast("double") / 20.0
        p1 = ((tid + 2 * k) % 7).cast("double") / 20.0
        cols[f"p2_{k}"] = p2
        cols[f"p1_{k}"] = p1
        cols[f"p0_{k}"] = 1.0 - p1 - p2
    return ds.withColumns(cols)


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-run writes derived from ``events``: repeated run ids (one per
    user), two model types, null metrics per type, ties on the hour."""
    e = read_table(spark, sf_dir, "events")
    is_est = F.col("event_type").isin("click", "view", "purchase")
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("seq"),
        F.md5(F.concat(F.lit("run|"), F.col("user_id").cast("string"))).alias("run_id"),
        F.date_trunc("hour", F.col("ts")).alias("created_at"),
        F.when(F.col("event_id") % 3 == 0, "feedback").when(F.col("event_id") % 3 == 1, "manual")
         .otherwise("seed").alias("trigger"),
        F.when(is_est, "estimate").otherwise("risk").alias("model_type"),
        F.when(is_est, v / 997.0).alias("r2"),
        F.when(is_est, v / 89.0).alias("mae"),
        F.when(is_est, v / 71.0).alias("rmse"),
        F.when(~is_est, (v % 100) / 101.0).alias("overrun_recall"),
        F.when(is_est, F.array(*[(v + i) / 997.0 for i in range(5)]))
         .otherwise(F.array().cast("array<double>")).alias("fold_scores"),
    )
