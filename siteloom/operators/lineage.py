"""Cutting the lineage of tables that loops go back to."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Levels after which a loop cuts the union of all its levels.
EVERY = 16


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all run on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        import tempfile

        base = tempfile.mkdtemp(prefix="siteloom-")
    return base


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir and read from there; to a temporary folder only where none is set, as in tests."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
