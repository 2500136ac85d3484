"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``, further columns of any name among them. Between stages the documents are written as Parquet in the
shared folder and read again, and what the stage before had stored on the way is deleted.

No stage fails on nulls in any column, on empty or very long texts, ties, repeated rows or an empty table; the
docstring of each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, near_copies, packing, quality, toxicity
from parlance.llm.common import release, store, stored_now, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores under one half.

    Null and empty texts are scored as an empty window, and repeated rows and rows without an id each by themselves.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the host rules at their host's limits.

    Null and empty texts go as too short; a null source is a host of its own; repeated rows are judged each.
    """
    return quality.drop_low_quality(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near-copies: five-word shingles, similarity 0.8 or more.

    Candidates are SimHash fingerprints within 4 bits, and MinHash bands for the near-copies beyond these.
    Repeated rows and rows of one id are one document; rows without an id stay where no row of their class has one,
    one of each class; null and empty texts are copies of each other.
    """
    return near_copies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Rows of one id are one document and go together; documents without an id cannot be named and stay, as do null
    and empty texts.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their place and checksum.

    Null and empty texts are an end id alone; every row is packed, with the id that it has or null.
    """
    return packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packed_sequences),
]

#: The toxicity network cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = stored_now()
        docs = store(stage(spark, docs, sf_dir), name)
        release(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
