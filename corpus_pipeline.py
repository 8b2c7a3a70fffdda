"""The corpus pipeline: each stage works on all that its predecessor kept and returns the columns of documents.

Defined cases: a document with a null or empty text passes the first three stages and is in no sequence; one with a null id
is judged like any other, and its id is null in the sequence; of rows repeated whole one stays; of copies the document of the
smallest id stays; texts of any length are read whole; an empty table has no sequences; without labels the lexicon's seeds
stand alone; further columns are carried to the last stage, whatever their names, and left out there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import minhash, packing, pii, toxicity
from sylvan.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, taught by the labels, rejects go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near or exact copies stays: that of the smallest id."""
    return minhash.drop_near_duplicates(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data in the texts give way to their kinds; every document stays."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of whole texts and cut ones, each with the ids and places of its pieces."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("pii", redact_private), ("packing", pack)]

#: No stage of the whole can be stated in SQL (a trained sequence model redacts); the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}-{name}")
    return docs
