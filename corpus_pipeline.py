"""From raw documents to packed training sequences: five stages, each one operator of foliary.llm.

Each stage takes the documents that its predecessor kept, with all their columns; the last returns pieces of
sequences. A driver may write every stage's result and read it back, as run() does. In all stages a null text is an
empty one, a null doc_id or source is a value of its own, and no rows give no rows; the operators' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliary.llm.mixing import mixed_documents
from foliary.llm.neardup import without_near_duplicates
from foliary.llm.packing import pack_documents
from foliary.llm.repeats import without_repeats
from foliary.llm.scratch import materialize
from foliary.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labels' model rejects go; equal texts go or stay together."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays, one with the least doc_id; texts without words are one class."""
    return without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that come in two documents go from all of them; a document may be left empty, none is dropped."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for; the one at a budget's edge in part, those without words not at all."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, each sequence with every source's share of the tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the learned and hashed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
