"""Issue-export readers: nested JSON pages -> flat rows, and export filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse as P

# Custom field ids of the export (story points, region,
# subsystem, commitments).
STORY_POINTS_FIELD = "customfield_10011"
REGION_FIELD = "customfield_11949"
SUBSYSTEM_FIELD = "customfield_12703"
COMMITMENTS_FIELD = "customfield_12800"

_OPTION = T.StructType([T.StructField("value", T.StringType())])
FIELDS_SCHEMA = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("timespent", T.DoubleType()),
    T.StructField("created", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField(STORY_POINTS_FIELD, T.DoubleType()),
    T.StructField(REGION_FIELD, T.ArrayType(_OPTION)),
    T.StructField(SUBSYSTEM_FIELD, T.StructType([
        T.StructField("value", T.StringType()),
        T.StructField("child", _OPTION),
    ])),
    T.StructField(COMMITMENTS_FIELD, _OPTION),
])
PAGE_SCHEMA = T.StructType([
    T.StructField("total", T.LongType()),
    T.StructField("issues", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("fields", FIELDS_SCHEMA),
    ]))),
])


def read_issue_pages(spark: SparkSession, path: str, one_page_per_file: bool = True) -> DataFrame:
    """Search-result pages with a fixed schema: one JSON document per file
    (saved API responses) or JSON Lines with one page per line."""
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", one_page_per_file).json(path)


def flatten_issues(pages: DataFrame, parse_options: bool = True) -> DataFrame:
    """pages -> one row per issue with renamed custom fields.

    Missing summary/description become ''.  Option fields are reduced to
    strings with the same rules as the literal parsers (``parse_options``),
    or kept as structs: the result needs no further parsing.  An issue that is
    repeated across pages (offset paging over a changing list) is kept once, in
    its newest version: the one with the most time spent, then the largest of the
    other columns in their order.
    """
    issues = pages.select(F.explode("issues").alias("i")).select("i.key", "i.fields.*")
    out = issues.select(
        F.col("key"),
        F.coalesce(F.col("summary"), F.lit("")).alias("summary"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.col("timespent").alias("time_spent"),
        F.col(STORY_POINTS_FIELD).alias("estimate"),
        F.col("created").alias("created_at"),
        F.col("status"),
        F.col("project"),
        F.col(REGION_FIELD).alias("region"),
        F.col(SUBSYSTEM_FIELD).alias("subsystem"),
        F.col(COMMITMENTS_FIELD).alias("commitments"),
    )
    if parse_options:
        out = out.withColumns({
            "region": F.when(F.col("region").isNull(), F.lit(P.DEFAULT_REGION)).otherwise(P.region_from_struct("region")),
            "subsystem": P.subsystem_from_struct("subsystem"),
            "commitments": P.commitments_from_struct("commitments"),
        })
    # The order of versions holds every column: the largest is the version, and no text moves twice.
    rest = [c for c in out.columns if c not in ("key", "time_spent")]
    newest = F.max(F.struct("time_spent", F.struct(*rest).alias("r")))
    v = out.groupBy("key").agg(newest.alias("v"))
    return v.select("key", *[F.col("v.time_spent" if c == "time_spent" else f"v.r.{c}") for c in out.columns if c != "key"])


def filter_export(df: DataFrame, project: str, cap: int | None = None, project_col: str = "project",
                  status_col: str = "status", created_col: str = "created_at", key_col: str = "ticket_id",
                  done: str = "Done") -> DataFrame:
    """Project = P, status Done, story points and time spent present.  With
    ``cap`` only the newest so many (ties by key); without, all of them, in
    no particular order."""
    f = df.filter((F.col(project_col) == project) & (F.col(status_col) == done)
                  & F.col("estimate").isNotNull() & F.col("time_spent").isNotNull())
    return f if cap is None else f.orderBy(F.col(created_col).desc(), F.col(key_col).asc()).limit(cap)
