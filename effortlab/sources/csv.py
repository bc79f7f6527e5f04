"""CSV readers with the export's parsing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.prepare import DATASET_COLUMNS
from .records import records

SEED_COLUMNS = ["key", "summary", "description", "time_spent", "estimate", "region", "subsystem", "commitments"]
SEED_NUMERIC = {"time_spent", "estimate"}
SPLIT_STRING = ["text", "region", "subsystem", "commitments"]
SPLIT_DOUBLE = ["estimate", "logged_days"]
SPLIT_INT = ["risk_level", "has_description", "has_code_block", "is_dev_task", "is_test_task",
             "is_analysis_task", "text_len", "word_count"]
SPLIT_COLUMNS = DATASET_COLUMNS
# Tokens read as missing by the default NA parsing of the
# original CSV reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


# One field of a record that has a comma in front.
_FIELD = r',(?:"[^"]*+(?:""[^"]*+)*+"?+[^,]*+|[^,]*+)'


def _parsed(spark: SparkSession, path: str, cols, **options) -> DataFrame:
    """String columns of the header CSV files under ``path``: records are cut in
    parallel (see :mod:`records`), each is parsed by Spark's CSV parser."""
    schema = ", ".join(f"`{c}` string" for c in cols)
    row = F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE", **options})
    return records(spark, path).select(row.alias("row")).select("row.*")


def _present(c: str):
    return F.when(~F.col(c).isin(NA_TOKENS), F.col(c))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with quoted multi-line text.  Rows with too many fields are
    skipped, short rows are kept with nulls; tokens of missing values become
    null in every column; numbers are ``try_cast`` (unparseable -> null).

    The parser flags every row whose number of fields is not the header's and
    keeps its raw text; the fields of such a row are counted there."""
    raw = _parsed(spark, path, [*SEED_COLUMNS, "_raw"], columnNameOfCorruptRecord="_raw")
    fields = F.size(F.regexp_extract_all(F.concat(F.lit(","), "_raw"), F.lit(_FIELD), 0))
    raw = raw.filter(F.col("_raw").isNull() | (fields <= len(SEED_COLUMNS))).drop("_raw")
    return raw.withColumns({c: _present(c) for c in SEED_COLUMNS}).withColumns(
        {c: F.expr(f"try_cast({c} as double)") for c in SEED_NUMERIC})


def read_split(spark: SparkSession, path: str, keep_empty: bool = True) -> DataFrame:
    """A prepared split.  ``keep_empty`` keeps '' and 'NA' as text (strings
    stay strings); otherwise '' and NA tokens become null."""
    # Quoted empty strings stay '', and no text is read as null.
    df = _parsed(spark, path, SPLIT_COLUMNS, **({"emptyValue": "", "nullValue": "\u0000"} if keep_empty else {}))
    cols = {}
    for c in SPLIT_STRING:
        cols[c] = F.coalesce(F.col(c), F.lit("")) if keep_empty else _present(c)
    for c in SPLIT_DOUBLE:
        cols[c] = F.expr(f"try_cast({c} as double)")
    for c in SPLIT_INT:
        cols[c] = F.expr(f"try_cast(try_cast({c} as double) as int)")
    return df.withColumns(cols)


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet") -> None:
    """Persist the prepared data partitioned by split, so reading one split
    prunes the others at planning time."""
    w = df.write.mode("overwrite").partitionBy(split)
    if fmt == "csv":
        # The CSV writer trims values by default; text must round-trip exactly.
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)
