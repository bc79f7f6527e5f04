"""Corpus pipeline: five stages over ``documents``, from raw texts to token ids.

Each stage is written as Parquet and read again as the next one's input, so
a lost executor or driver costs one stage at most.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlab.llm import bpe, jaccard_trie, mixing, quality_gam, toxicity_nb
from effortlab.llm.common import Scratch, held_out, small_batches, table
from effortlab.llm.queries import BYTE_BPE, MIX_SHORTFALL, MIX_TARGETS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 or more)."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 4, 2))
    model = quality_gam.fit(docs, labels)
    return quality_gam.score(docs, model, out="quality_score").filter("quality_score >= 0.7").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts (score under 0.5)."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    model = toxicity_nb.fit(docs, labels)
    return toxicity_nb.score(docs, model, out="toxic_score").filter("toxic_score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8)."""
    small_batches(spark)
    return jaccard_trie.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the tokens meet the target shares."""
    small_batches(spark)
    drawn = mixing.mix(mixing.describe(docs), MIX_TARGETS, text="text", shortfall=MIX_SHORTFALL)
    return drawn.filter("taken").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    small_batches(spark)
    return bpe.encode(docs, BYTE_BPE)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates),
          ("mixture", mixture), ("tokens", tokens)]

#: SQL expresses neither the classifiers nor the merges; tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
