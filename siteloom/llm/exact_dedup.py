"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first scan keeps a count for each (length, prefix hash) and nothing else. Groups of one leave there. The second scan
reads the full content and hashes it only for rows whose length and prefix are shared. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import Stage, keep_first, row_key

PREFIX = 256
#: Rows of (length, prefix hash) up to which they are sent to every executor: 24 bytes each, so 48 MB at most.
SEND_ROWS = 2_000_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hashed_rows(docs: DataFrame, stage: Stage, id_col: str, text_col: str, prefix: int, digest: bool, send_rows: int) -> DataFrame:
    """key, doc_id, shared (whether another row shares length and prefix), text_sha256 (null unless shared or digest)."""
    norm = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = norm.select("key", "doc_id", "norm", F.octet_length("norm").alias("n_bytes"), F.xxhash64(F.substring("norm", 1, prefix)).alias("prefix_hash"))
    counts = stage.put(keyed.groupBy("n_bytes", "prefix_hash").agg(F.count(F.lit(1)).alias("n")), "lengths")
    lengths = counts.groupBy("n_bytes").agg(F.sum("n").alias("n_length")).filter("n_length > 1")
    shared = stage.put(counts.join(lengths, "n_bytes", "left_semi").filter("n > 1").select("n_bytes", "prefix_hash", F.lit(True).alias("shared")), "shared")
    small = shared.limit(send_rows + 1).count() <= send_rows
    survivors = keyed.join(F.broadcast(shared) if small else shared, ["n_bytes", "prefix_hash"], "left")
    full = F.sha2(F.encode("norm", "UTF-8"), 256)
    return stage.put(survivors.select("key", "doc_id", F.col("shared").isNotNull().alias("shared"), full.alias("text_sha256") if digest else F.when(F.col("shared"), full).alias("text_sha256")), "hashes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False, send_rows: int = SEND_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows whose normalised texts are equal form a group; keep_id is its smallest id. Null texts count as empty, so all null
    and empty texts are one group. Null ids come last: keep_id is null only if all ids of the group are. Repeated rows
    (same id and text) all count in group_size and all have kept = true where the id is the smallest. An empty table gives
    no rows. Other columns of the input play no part, whatever their names. text_sha256 is null for rows that no other
    row shares length and prefix with, unless digest is set.
    """
    stage = Stage(docs.sparkSession, "exact-dedup")
    hashed = hashed_rows(docs, stage, id_col, text_col, prefix, digest, send_rows)
    groups = hashed.filter("shared").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = stage.put(groups, "groups")  # so that the join below deals both sides out itself, and may split a side that is skewed
    found = hashed.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without exact copies: of each group one row with the smallest id stays, null ids last."""
    stage = Stage(docs.sparkSession, "exact-dedup")
    hashed = hashed_rows(docs, stage, id_col, text_col, PREFIX, False, SEND_ROWS)
    return keep_first(docs, hashed.filter("shared").select("key", "doc_id", F.col("text_sha256").alias("grp")), stage, id_col, text_col)
