"""A corpus pipeline: toxic documents go, near copies go, sources are mixed to target weights, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read back as the next
stage's documents. Stages treat rows with nulls, repeated rows and empty texts as their operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnmap.llm.common import stored, table
from cairnmap.llm.mixing import mixed_documents
from cairnmap.llm.near_dedup import drop_near_duplicates
from cairnmap.llm.packing import pack_documents
from cairnmap.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of rows outside the held-out fifth."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as rows: a document appears once per pass, cut where its source's target ends."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Fitted models and iterative components aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
