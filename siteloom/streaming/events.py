"""Counters, windows and saturation over a growing event log."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siteloom.sources import readers


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events of the JSON-lines files that appear in a folder."""
    return readers.event_log(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts; write in update mode."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, ts: str, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window of event time; events later than `late` are left out. An extension."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap. An extension like windowed()."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *keys, "n")


class Saturation(StatefulProcessor):
    """Per run: patterns seen, and whether each of the last pages brought a new one. State grows with the distinct patterns of a run."""

    def __init__(self, last: int, patterns: int):
        self.last, self.patterns = last, patterns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "pattern string", "n long")
        self.recent = handle.getValueState("recent", "flags string, pages long, new_pages long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        # Of a batch's rows only the first of each pattern and the last pages are held; the state is asked once for each pattern.
        before = self.recent.get()
        flags, pages, new_pages = before or ("", 0, 0)
        firsts: list[dict] = [{} for _ in range(self.patterns)]
        ends: list[tuple] = []
        n = 0
        for df in rows:
            at = [(True, 0, i) if pd.isna(o) else (False, o, i) for i, o in enumerate(df["ord"].tolist(), n)]  # of one ord, and without any, as they come
            n += len(at)
            ends = heapq.nlargest(self.last, ends + at)
            for k, first in enumerate(firsts):
                for p, o in zip(df[f"p{k}"].tolist(), at):
                    if p not in first or o < first[p]:
                        first[p] = o
        names: dict[str, tuple] = {}
        for k, first in enumerate(firsts):
            for p, o in first.items():
                if not pd.isna(p) and str(p).strip():
                    name = f"{k}:{str(p).lower()}"
                    names[name] = min(o, names.get(name, o))
        new = set()
        for name, o in names.items():
            if before is None or not self.seen.containsKey((name,)):
                self.seen.updateValue((name,), (1,))
                new.add(o)
        flags = (flags + "".join("01"[o in new] for o in reversed(ends)))[-self.last :]
        pages, new_pages = pages + n, new_pages + len(new)
        self.recent.update((flags, pages, new_pages))
        yield pd.DataFrame({"run_id": [key[0]], "pages": [pages], "new_pages": [new_pages], "new_in_window": [flags.count("1")], "saturated": [pages >= self.last and "1" not in flags]})

    def close(self) -> None:
        pass


def saturation(events: DataFrame, patterns: list[str], last: int) -> DataFrame:
    """run_id, pages, new_pages, new_in_window, saturated after each batch; events: run_id, ord and the patterns. Order holds within a batch."""
    own = events.select("run_id", "ord", *(F.col(p).cast("string").alias(f"p{k}") for k, p in enumerate(patterns)))
    return own.groupBy("run_id").transformWithStateInPandas(Saturation(last, len(patterns)), "run_id string, pages long, new_pages long, new_in_window long, saturated boolean", "Update", "None")


def run_once(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is there; each batch's rows are written below `folder`, where its checkpoint is, and read back with their batch."""
    spark = df.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(provider).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/{batch}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema.add("batch", "long")).option("recursiveFileLookup", True).parquet(f"{folder}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of what an update stream wrote, the last row of each key."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")
