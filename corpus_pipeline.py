"""Corpus preparation in stages: each works on all that the one before it kept, written as Parquet and read again.

The stages drop documents that the quality classifier rejects, all but one of each group of near duplicates
(five words, 0.8), repeated passages of 200 bytes, and documents with benchmark items; the last one packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelmill.llm.decontaminate import without_contaminated
from voxelmill.llm.near_dedup import keep_one
from voxelmill.llm.packing import pack_documents
from voxelmill.llm.quality import keep_good
from voxelmill.llm.scratch import new_folder, table
from voxelmill.llm.suffix_dedup import without_repeats
from voxelmill.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of sf_dir and the texts of docs, scores a half or more.

    A null or empty text has the score of no words; without labels all stay. Repeated rows are scored each, an empty table gives an empty one.
    """
    ship(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 and more over five-word shingles join: that of the least doc_id, null last.

    Documents without words stay; of rows that repeat a doc_id and text one stays.
    """
    ship(spark)
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of 200 bytes that start at two places or more; those of which nothing is left go.

    A null text becomes empty; n_chars counts what is left.
    """
    ship(spark)
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of sf_dir's benchmark is found, as it is or with other numbers, names and units. Null and empty texts stay."""
    ship(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens. A null or empty text is one token; repeated rows are packed each."""
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the learnt classifier, the links' components or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
