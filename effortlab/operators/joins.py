"""Join helpers: lookups with a fallback value, marks, anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def lookup_with_fallback(df: DataFrame, stats: DataFrame, key: str, value: str,
                         default: Column, out: str | None = None) -> DataFrame:
    """Map each row's ``key`` to ``stats.value``; unseen or null keys get
    ``default`` (a column, e.g. a scalar subquery).  Whether the statistics are
    broadcast is left to adaptive execution, which knows their size in bytes."""
    out = out or value
    s = stats.select(F.col(key).alias("_lk"), F.col(value).alias("_lv"))
    j = df.join(s, df[key] == s["_lk"], "left")
    return j.withColumn(out, F.coalesce(F.col("_lv"), default)).drop("_lk", "_lv")


def join_features(emb: DataFrame, meta: DataFrame, key: str = "ticket_id", how: str = "inner") -> DataFrame:
    """Embedding rows joined to metadata on a stable id (no row positions in
    a distributed table)."""
    return emb.join(meta, key, how)


def mark_used(fb: DataFrame, ids: DataFrame, id_col: str = "id",
              flag: str = "is_used_for_training") -> DataFrame:
    """Set ``flag`` = 1 for the given ids (left join, a new version of the table)."""
    marks = ids.select(F.col(id_col).alias("_mid")).distinct().withColumn("_hit", F.lit(1))
    j = fb.join(marks, fb[id_col] == marks["_mid"], "left")
    return j.withColumn(flag, F.when(F.col("_hit") == 1, F.lit(1)).otherwise(F.col(flag)).cast("int")) \
            .drop("_mid", "_hit")


def delete_matching(df: DataFrame, keys: DataFrame, col: str = "summary") -> DataFrame:
    """Rows whose ``col`` value is not in ``keys`` (anti join)."""
    return df.join(keys.select(F.col(col).alias("_dk")).distinct(), df[col] == F.col("_dk"), "left_anti")
