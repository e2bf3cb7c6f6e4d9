"""Corpus pipeline: ``documents`` in, packed training bins out.

Every stage takes (spark, docs, sf_dir) with ``docs`` a stored table, works on all rows its predecessor kept, and
returns the columns of ``documents``; the last one returns the places of the pieces in their bins.  SQL cannot express
the learned and the packed stages, so the tests hold every stage against brute force instead of an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.op3_packing import pack_documents
from kinweave.llm.op5_quality import keep_good
from kinweave.llm.op7_exact_dedup import drop_copies
from kinweave.llm.op8_jaccard import drop_near_copies
from kinweave.llm.op10_decontamination import drop_leaks
from kinweave.llm.store import keep, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return drop_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id."""
    return drop_near_copies(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and offset of every piece of every document."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
