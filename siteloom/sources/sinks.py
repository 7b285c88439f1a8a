"""Writers: tables, single JSON documents, JSON lines, and Markdown reports of one run."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, committed as a whole; by site and run where asked."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines, nulls left out, added to what is there."""
    df.write.mode("append").json(path)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def write_document(row: dict, path: str) -> None:
    """One small JSON document, indented, names in camel case; written aside and renamed, so that readers see all or nothing."""

    def renamed(x):
        if isinstance(x, dict):
            return {camel(k): renamed(v) for k, v in x.items() if v is not None}
        return [renamed(v) for v in x] if isinstance(x, list) else x

    write_text(json.dumps(renamed(row), indent=2, ensure_ascii=False, default=str), path)


def write_text(content: str, path: str) -> None:
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(content)
    os.replace(f.name, path)


def nested_tree(preordered: DataFrame, site: str) -> list[dict]:
    """The tree of one site, nested, from its preorder. For a document of one site: its rows come to the driver."""
    root: list[dict] = []
    stack: list[tuple[int, list]] = [(-1, root)]
    for r in preordered.filter(F.col("site_id") == site).orderBy("pos").select("url", "title", "level").toLocalIterator():
        while stack[-1][0] >= r.level:
            stack.pop()
        node = {"title": r.title, "url": r.url, "children": []}
        stack[-1][1].append(node)
        stack.append((r.level, node["children"]))
    return root


def _table(rows: list, names: list[str]) -> str:
    cells = lambda values: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in values) + " |"
    return "\n".join([cells(names), cells("---" for _ in names), *(cells(r[n] for n in names) for r in rows)])


def quality_markdown(metrics: DataFrame, warnings: DataFrame, site: str, top: int = 10) -> str:
    """A report of one site: its metrics and its warnings, errors first."""
    m = metrics.filter(F.col("site_id") == site).limit(1).collect()
    w = warnings.filter(F.col("site_id") == site).orderBy("severity_rank", "ord").limit(top).collect()
    lines = [f"# Quality of {site}", "", "## Metrics", ""]
    lines.append(_table([{"metric": k, "value": v} for k, v in m[0].asDict().items() if k != "site_id"], ["metric", "value"]) if m else "No pages.")
    return "\n".join([*lines, "", "## Warnings", "", _table(w, ["severity", "code"]) if w else "None.", ""])


def comparison_markdown(deltas: DataFrame, changes: DataFrame, most: int = 30) -> str:
    """A report of one comparison: metrics, and URLs that came and went, `most` of each."""
    lines = ["# Comparison", "", "## Metrics", "", _table(deltas.orderBy("metric").limit(100).collect(), ["metric", "previous", "current", "delta", "verdict"])]
    for change in ("added", "removed"):
        rows = changes.filter(F.col("change") == change).orderBy("url").limit(most).collect()
        lines += ["", f"## {change.capitalize()}", "", *(f"- {r.url}" for r in rows)]
    return "\n".join([*lines, ""])


def review_pack(metrics: DataFrame, warnings: DataFrame, rejections: DataFrame, failed: DataFrame, templates: DataFrame, site: str) -> str:
    """What a person looks at first: top ten warnings, top twenty failed URLs and reasons of rejection, ten templates that occur once."""
    reasons = rejections.orderBy(F.desc("n"), "reason").limit(20).collect()
    urls = failed.select("url").distinct().orderBy("url").limit(20).collect()
    rare = templates.filter("n = 1").orderBy("first_ord").limit(10).collect()
    body = [quality_markdown(metrics, warnings, site), "## Rejected links", "", _table(reasons, ["reason", "n"]), "", "## Failed pages", "", *(f"- {r.url}" for r in urls), "", "## Templates seen once", "", *(f"- {r['fingerprint']}" for r in rare), ""]
    return "\n".join(body)


def run_index(runs: DataFrame) -> DataFrame:
    """Runs, the latest folder name first."""
    return runs.orderBy(F.desc("folder"))


def site_index(scrapes: DataFrame) -> DataFrame:
    """Scrapes, the latest first."""
    return scrapes.orderBy(F.desc("generated_local"), "host")
