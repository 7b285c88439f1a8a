"""The corpus pipeline: documents through five operators of siteloom.llm, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm.common import Stage, table
from siteloom.llm.decontaminate import drop_contaminated
from siteloom.llm.exact_dedup import drop_exact_duplicates
from siteloom.llm.packing import pack
from siteloom.llm.simhash import drop_near_duplicates
from siteloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, doesn't reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark, however long they are around it."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the remaining documents fill."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: No SQL says what a trained classifier rejects; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage returns is written to the shared folder and read again by the next."""
    docs, written = table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for name, stage in STAGES:
        before = docs
        docs = written.put(stage(spark, docs, sf_dir), name)
        written.drop(before)
    return docs
