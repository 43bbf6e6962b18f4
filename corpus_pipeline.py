"""A corpus pipeline over the documents table: each stage applies one operator to what its predecessor kept.

STAGES names the stages in order; each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from idledger.llm.cluster import read, shared_path
from idledger.llm.mixing import draw
from idledger.llm.near_copies import drop_near_copies
from idledger.llm.packing import pack
from idledger.llm.quality_rules import keep_good
from idledger.llm.toxicity import drop_toxic
from idledger.shared import delete


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voted rules reject go."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: SimHash links, and an exact way
    for what they miss, over five-word shingles, held against a Jaccard similarity of 0.8."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are drawn to flattened target weights, without repeating documents."""
    return draw(docs, read(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenizing, hashing and iterative fitting are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on what the last one wrote; what a stage has read is deleted once it is no longer needed.

    Documents with null or empty texts, and short ones, go in the first stage. A null doc_id stays null,
    and its document goes through like any other, near_dedup included, which keeps it. Repeated rows of a
    kept doc_id leave one row. Very long texts are read whole in every stage and cut by the last. Ties are
    broken as each operator says. Columns of documents with whatever names are carried to the last stage.
    An empty table gives no rows.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            delete(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
