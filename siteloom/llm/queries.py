"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import table
from siteloom.llm.decontaminate import SPAN, contamination
from siteloom.llm.exact_dedup import exact_groups
from siteloom.llm import lm
from siteloom.llm.line_dedup import repeated_lines
from siteloom.llm.packing import pack
from siteloom.llm.pii import digest as pii_digest
from siteloom.llm.pii import find
from siteloom.llm.secrets import digest as secret_digest
from siteloom.llm.secrets import scan
from siteloom.llm.simhash import near_duplicates
from siteloom.llm.substring_dedup import digest as substring_digest
from siteloom.llm.substring_dedup import remove_repeats
from siteloom.llm.toxicity import toxicity


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words inside phrases of the benchmark, the items they belong to, and places that have a phrase's words nearby."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=SPAN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, their links to different lines, and the numbers of the lines that go."""
    found = repeated_lines(table(spark, sf_dir, "documents"), grow=True)
    return found.withColumn("dropped", F.array_join("dropped", ","))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find(table(spark, sf_dir, "documents")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest=True)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(remove_repeats(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontaminate": op1_decontaminate, "op2_line_dedup": op2_line_dedup, "op3_toxicity": op3_toxicity, "op4_pii": op4_pii, "op5_secrets": op5_secrets, "op6_exact_dedup": op6_exact_dedup, "op7_lm": op7_lm, "op8_packing": op8_packing, "op9_substring_dedup": op9_substring_dedup, "op10_simhash": op10_simhash, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
                 g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""",
    }
