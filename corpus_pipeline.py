"""A corpus made ready for training: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes to the shared folder and reads again as the next stage's documents. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import near_dedup, packing, quality_rules, secret_scan, suffix_dedup
from loomgraph.llm.common import drop_staged, scratch, staged_as, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of the default policy."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity from 0.8."""
    return near_dedup.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes or more that a document with a smaller id holds; n_chars follows the text, and a text that is gone stays as an empty one."""
    return suffix_dedup.without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by its kind; n_chars follows."""
    return secret_scan.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeats),
    ("secrets", secrets),
    ("packing", sequences),
]

#: Near duplicates, repeated strings and packing can't be put in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():  # what the stage wrote on its way goes once its result is written
            docs, new = staged_as(stage(spark, docs, sf_dir), name.replace(" ", "_"), lasting=True)
        if at:
            drop_staged(at)
        at = new
    return STAGES[-1][1](spark, docs, sf_dir)
