"""Options of a run from a command line, targets from a file, and the run's log."""

from __future__ import annotations

import argparse
import time
from contextlib import contextmanager
from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGETS = "targets array<struct<name:string,url:string,expectedCms:string,profile:string,notes:string>>"


@dataclass
class Options:
    """What a run may be told; the defaults are fixed values."""

    input_file: str = "sites.txt"
    output_dir: str = "output"
    dated_output: bool = True
    max_depth: int = 3
    max_pages: int = 1500
    max_bytes: int = 150 << 30
    viewport: tuple[int, int] = (1920, 1080)
    shot_timeout_ms: int = 60_000
    nav_timeout_ms: int = 45_000
    network_idle_ms: int = 8_000
    stabilize_ms: int = 12_000
    scroll_settle_ms: int = 350
    delay_ms: int = 0
    scroll_step: int = 0
    tile_overlap: int = 120
    max_tiles: int = 5000
    webp_quality: int = 75
    landing_only: bool = False
    quick_preview: bool = False
    preview_pages_per_depth: int = 25
    preview_children_per_page: int = 18
    preview_seconds: int = 90
    debug: bool = False
    drop_query: bool = True
    progress_every: int = 20
    user_agent: str | None = None

    def checked(self) -> Options:
        """These options; ValueError names the first that makes no sense."""
        rules = (
            (self.max_depth >= 0, "max_depth cannot be negative"), (self.max_pages > 0, "max_pages must be positive"), (self.max_bytes > 0, "max_bytes must be positive"), (min(self.viewport) >= 100, "viewport must be at least 100x100"),
            (1 <= self.webp_quality <= 100, "webp_quality must be between 1 and 100"), (min(self.shot_timeout_ms, self.nav_timeout_ms) > 0, "timeouts must be positive"), (self.tile_overlap >= 0, "tile_overlap cannot be negative"),
            (self.max_tiles > 0, "max_tiles must be positive"), (self.progress_every > 0, "progress_every must be positive"),
            (not self.quick_preview or min(self.preview_pages_per_depth, self.preview_children_per_page, self.preview_seconds) > 0, "a preview's limits must be positive"),
        )
        for right, says in rules:
            if not right:
                raise ValueError(says)
        return self


def _size(text: str) -> tuple[int, int]:
    w, h = text.lower().split("x")
    return int(w), int(h)


#: Names on the command line, where they aren't the option's own.
NAMES = {
    "input_file": ("--input", "--sites", "--sites-file"), "output_dir": ("--output", "--out"), "max_pages": ("--max-pages", "--max-pages-per-site"), "max_bytes": ("--cap-bytes",), "landing_only": ("--landing-only", "--landingpage-only"),
    "quick_preview": ("--quick-preview", "--preview", "--test-preview"), "progress_every": ("--progress-every", "--progress-every-seconds"), "drop_query": ("--drop-query", "--drop-query-strings"),
}


def parsed(arguments: list[str]) -> Options:
    """Options from a command line, checked. Unknown ones end the program with its usage."""
    p = argparse.ArgumentParser(allow_abbrev=False)
    for f in fields(Options):
        names = NAMES.get(f.name, ("--" + f.name.replace("_", "-"),))
        if f.name == "dated_output":
            p.add_argument("--no-dated-output", dest=f.name, action="store_false", default=f.default)
        elif isinstance(f.default, bool):
            p.add_argument(*names, dest=f.name, action="store_true", default=f.default)
        else:
            p.add_argument(*names, dest=f.name, type=_size if f.name == "viewport" else int if isinstance(f.default, int) else str, default=f.default)
    p.add_argument("--keep-query", "--keep-query-strings", dest="drop_query", action="store_false")
    p.add_argument("--cap-gb", dest="max_bytes", type=lambda x: int(float(x) * (1 << 30)))
    return Options(**vars(p.parse_args(arguments))).checked()


def targets(spark: SparkSession, *paths: str) -> DataFrame:
    """name, url, expected_cms, profile, notes from the first of the paths that has a readable target file; none if none has."""
    for path in paths:
        try:
            found = spark.read.schema(TARGETS).option("multiLine", True).json(path).select(F.explode("targets").alias("t")).select("t.name", "t.url", F.col("t.expectedCms").alias("expected_cms"), "t.profile", "t.notes")
            if found.head() is not None:
                return found
        except Exception as e:  # no such file
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], "name string, url string, expected_cms string, profile string, notes string")


class EventLog:
    """Lines of `time level name key=value ...`, and scopes that tell their start, their end and how long they took."""

    def __init__(self, write=print):
        self.write = write

    def line(self, level: str, text: str) -> None:
        self.write(f"{datetime.now().isoformat(timespec='milliseconds')} {level} {text}")

    def event(self, name: str, **values) -> None:
        shown = (f'"{v}"' if isinstance(v, str) and (" " in v or not v) else v for v in values.values())
        self.line("EVT", " ".join([name, *(f"{k}={v}" for k, v in zip(values, shown))]))

    @contextmanager
    def scope(self, name: str, **values):
        began = time.monotonic()
        self.event(f"{name}_START", **values)
        try:
            yield self
        finally:
            self.event(f"{name}_END", **values, ms=int((time.monotonic() - began) * 1000))
