"""seed -> dataset: text, structural features, targets, labels, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import parse as P
from ..functions import text as T

# The names and order of the dataset's columns.
DATASET_COLUMNS = ["text", "estimate", "logged_days", "risk_level", *L.CATEGORICAL_FEATURES, *T.FEATURE_COLUMNS]
# Columns kept in addition for joins and error reports.
KEY_COLUMNS = ["ticket_id", "summary", "description"]


def prepare_dataset(seed: DataFrame, parse_literals: bool = False, strip_text: bool = False) -> DataFrame:
    """One lazy projection/filter plan.

    The validity filter only reads ``time_spent`` and ``estimate``; Catalyst
    moves it under the feature projection, so features are computed for kept
    rows only.  Where the estimate is an expression of the scanned columns, only its
    null check reaches the scan.
    """
    if "ticket_id" not in seed.columns and "key" in seed.columns:
        seed = seed.withColumn("ticket_id", F.col("key"))          # export key as the stable id
    df = L.filter_valid(seed.withColumn("logged_days", L.to_workdays("time_spent")))
    df = T.fill_text(df)
    df = df.withColumn("text", T.concat_text("summary", "description", strip=strip_text))
    df = T.text_features(df, "text", "description")
    if parse_literals:
        df = df.withColumns({
            "region": P.parse_region("region"),
            "subsystem": P.parse_subsystem("subsystem"),
            "commitments": P.parse_commitments("commitments"),
        })
    df = df.withColumn("risk_level", L.risk_level("logged_days", "estimate"))
    return df.select(*KEY_COLUMNS, *DATASET_COLUMNS)


def risk_distribution(df: DataFrame) -> DataFrame:
    """Rows and share per risk class (share via a window over 3 rows)."""
    from pyspark.sql import Window
    counts = df.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))
