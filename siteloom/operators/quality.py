"""Quality of a run: counts over pages, counts over the event log, saturation, warnings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import tree
from siteloom.operators.classify import is_utility_page

KEYS = ("site_id",)


def verdict(root_children: Column, deep: Column, raw: Column, utility: Column, discovered: Column, synthetic: Column) -> Column:
    return F.when((root_children > 50) | (deep > 20) | (raw > 0), "FAIL").when((deep > 0) | (utility > 5) | (discovered > 10) | (synthetic > 8), "PASS_WITH_MINOR_ISSUES").otherwise("PASS")


def root_topology(items: DataFrame) -> DataFrame:
    """One row per site: counts of the pages below the root and the verdict. items: site_id, url, title, parent_url, start_url, flags."""
    df = items.filter((F.lower("parent_url") == F.lower("start_url")) & (F.lower("url") != F.lower("start_url")))
    u, t = F.col("url"), F.coalesce(F.col("title"), F.lit(""))
    synthetic = F.coalesce(F.col("is_synthetic"), F.lit(False)) if "is_synthetic" in items.columns else F.lit(False)
    utility = is_utility_page(u, t)
    deep = urls.path_segment_count(u) >= 2
    parents = items.select("site_id", F.lower("parent_url").alias("_node")).filter("_node <> ''").distinct().withColumn("_has", F.lit(True))
    df = df.withColumn("_node", F.lower("url")).join(parents, ["site_id", "_node"], "left")
    leaf = F.col("_has").isNull()
    discovered = ~utility & (synthetic | deep)
    out = df.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("root_children"), F.count_if(deep).alias("deep"), F.count_if(~utility & ~discovered).alias("structural"), F.count_if(utility).alias("utility"), F.count_if(discovered).alias("discovered"),
        F.count_if(deep & leaf).alias("deep_leaf"), F.count_if(leaf).alias("singleton"), F.count_if(synthetic).alias("synthetic"), F.count_if(urls.is_raw_url_title(t, u)).alias("raw_title"),
    )
    c = F.col
    return out.withColumn("verdict", verdict(c("root_children"), c("deep"), c("raw_title"), c("utility"), c("discovered"), c("synthetic")))


def orphans(items: DataFrame) -> DataFrame:
    """Pages whose parent is named but not among the site's pages and not its start page."""
    named = items.filter((F.trim(F.coalesce("parent_url", F.lit(""))) != "") & (F.lower("parent_url") != F.lower("start_url"))).withColumn("_key", F.lower("parent_url"))
    return named.join(items.select("site_id", F.lower("url").alias("_key")), ["site_id", "_key"], "left_anti").drop("_key")


def duplicate_groups(items: DataFrame, key: Column, name: str) -> DataFrame:
    """Per site the number of keys that more than one row has; blank keys don't count."""
    g = items.withColumn("_k", F.lower(key)).filter(F.trim("_k") != "").groupBy("site_id", "_k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.groupBy("site_id").agg(F.count(F.lit(1)).alias(name))


def nav_metrics(items: DataFrame) -> DataFrame:
    """One row per site: flat, tree_nodes, orphans, duplicate_urls, duplicate_titles, empty_titles, synthetic and the root counts."""
    base = items.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("flat"), F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("empty_titles"), F.count_if(F.coalesce("is_synthetic", F.lit(False))).alias("synthetic_parents"), F.max("depth").alias("max_depth")
    )
    parts = (
        tree.node_counts(items).select("site_id", "tree_nodes"), orphans(items).groupBy("site_id").agg(F.count(F.lit(1)).alias("orphans")),
        duplicate_groups(items, F.col("url"), "duplicate_urls"), duplicate_groups(items, F.col("title"), "duplicate_titles"), root_topology(items),
    )
    for p in parts:
        base = base.join(p, "site_id", "left")
    return base.na.fill(0)


# ---- events: run_id, ord, event, depth, outlinks, error_kind, reason, fingerprint, path_shape, content_type ... -----


def event_counters(events: DataFrame, keys: list[str], names: dict[str, Column]) -> DataFrame:
    """Conditional counts over the log in one pass."""
    return events.groupBy(*keys).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in names.items()))


def visit_counters(events: DataFrame) -> DataFrame:
    """Per run: visits, failures, timeouts, snapshots, text failures, critical events, depths, the mean of outlinks rounded half to even."""
    e, sev = F.col("event"), F.lower(F.coalesce(F.col("severity"), F.lit("")))
    ok = e == "page_visit_success"
    return events.groupBy("run_id").agg(
        F.count_if(ok).alias("visited"), F.count_if(e == "page_visit_fail").alias("failed"), F.count_if((e == "page_visit_fail") & F.lower("error_kind").contains("timeout")).alias("timeouts"),
        F.count_if(e == "snapshot_success").alias("captured"), F.count_if(e == "snapshot_fail").alias("snapshot_fail"), F.count_if(e == "text_extract_fail").alias("text_fail"), F.count_if(sev == "critical").alias("critical"),
        F.max(F.when(ok, F.col("depth"))).alias("max_depth"), F.bround(F.avg(F.when(ok, F.col("outlinks"))), 1).alias("average_outlinks"),
        F.max_by("cms", F.when(e == "cms_detected", F.col("ord"))).alias("cms"), F.max(F.coalesce(F.when(e == "crawl_complete", F.col("max_pages_reached")), F.lit(False))).alias("max_pages_reached"),
    )


def pages_by_depth(events: DataFrame) -> DataFrame:
    return events.filter("event = 'page_visit_success' and depth is not null").groupBy("run_id", "depth").agg(F.count(F.lit(1)).alias("pages"))


def rejections(events: DataFrame, compat: bool = False) -> DataFrame:
    """Per run and reason the rejected links. A page's summary counts what its single events have told already.

    compat: add both up, as the log's first reader did. Else summaries count, and single events where a run has no summary.
    """
    single = events.filter("event = 'link_rejected' and reason is not null").groupBy("run_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    summed = events.filter("event = 'link_rejections_summary'").select("run_id", F.explode("reasons").alias("reason", "n")).groupBy("run_id", "reason").agg(F.sum("n").alias("n"))
    if not compat:
        single = single.join(summed.select("run_id").distinct(), "run_id", "left_anti")
    return single.unionByName(summed).groupBy("run_id", "reason").agg(F.sum("n").alias("n"))


def novelty(events: DataFrame, keys: list[str], patterns: list[str], order: str = "ord") -> DataFrame:
    """events with is_new: whether one of the patterns occurs for the first time in the log of its key. Blank patterns are never new."""
    firsts = []
    for p in patterns:
        own = Window.partitionBy(*keys, F.lower(p)).orderBy(order)
        firsts.append((F.trim(F.coalesce(F.col(p), F.lit(""))) != "") & (F.row_number().over(own) == 1))
    new = firsts[0]
    for f in firsts[1:]:
        new = new | f
    return events.withColumn("is_new", new)


def saturation(events: DataFrame, keys: list[str], patterns: list[str], last: int, order: str = "ord") -> DataFrame:
    """Per key: pages, distinct patterns, new ones among the last `last` pages, and whether there are that many pages and none is new."""
    back = Window.partitionBy(*keys).orderBy(F.desc(order))
    df = novelty(events, keys, patterns, order).withColumn("_back", F.row_number().over(back))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.count_if("is_new").alias("new_pages"), F.count_if((F.col("_back") <= last) & F.col("is_new")).alias("new_in_window"))
    return out.withColumn("saturated", (F.col("pages") >= last) & (F.col("new_in_window") == 0))


def until_saturated(events: DataFrame, keys: list[str], patterns: list[str], last: int, order: str = "ord") -> DataFrame:
    """events up to where a run could have stopped: the first page at which the last `last` pages had nothing new; all of a run that never got there."""
    own = Window.partitionBy(*keys).orderBy(order)
    df = novelty(events, keys, patterns, order).withColumn("_n", F.row_number().over(own)).withColumn("_new", F.sum(F.col("is_new").cast("int")).over(own.rowsBetween(1 - last, 0)))
    stop = F.min(F.when((F.col("_n") >= last) & (F.col("_new") == 0), F.col("_n"))).over(Window.partitionBy(*keys))
    return df.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("_n") <= F.col("_stop"))).drop("_n", "_new", "_stop")


def first_seen(events: DataFrame, keys: list[str], pattern: str, attributes: list[str], order: str = "ord", top: int = 20) -> DataFrame:
    """The most frequent patterns of each key, `top` at most, ties by first sight, with the attributes of their first event."""
    g = events.filter(F.trim(F.coalesce(F.col(pattern), F.lit(""))) != "").groupBy(*keys, pattern).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord"), *(F.min_by(a, order).alias(a) for a in attributes))
    own = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_ord")
    return g.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top)


#: code, severity, condition over the row of metrics.
WARNINGS = (
    ("no_pages_found", "error", "flat = 0"),
    ("tree_far_smaller_than_flat", "warning", "flat > 0 and tree_nodes < 0.3 * flat"),
    ("high_orphan_ratio", "warning", "flat > 0 and orphans / flat > 0.4"),
    ("high_duplicate_titles", "warning", "flat > 0 and duplicate_titles / flat > 0.15"),
    ("high_empty_title_ratio", "warning", "flat > 0 and empty_titles / flat > 0.1"),
    ("root_child_explosion", "error", "root_children > 50"),
    ("root_leaf_pollution", "error", "deep > 20"),
    ("root_child_path_depth_too_high", "warning", "deep > 0 and deep <= 20"),
    ("raw_url_labels_at_root", "error", "raw_title > 0"),
    ("synthetic_parents_inserted", "info", "synthetic_parents > 0"),
    ("homepage_sections_found", "info", "homepage_sections > 0"),
    ("missing_homepage_sections", "warning", "homepage_sections = 0 and flat > 20"),
    ("utility_root_pollution", "warning", "utility > 5"),
    ("orphan_content_cluster", "warning", "discovered > 10"),
    ("max_pages_reached", "warning", "max_pages_reached"),
    ("low_max_depth", "warning", "max_depth > 0 and max_depth < 2"),
    ("low_snapshot_ratio", "warning", "captures and flat > 5 and captured < flat div 2"),
    ("cms_mismatch", "warning", "cms_mismatch"),
    ("no_primary_nav_group", "warning", "primary_group = ''"),
    ("low_average_outlinks", "warning", "nav_groups > 0 and flat > 0 and average_outlinks < 2"),
    ("high_timeout_count", "warning", "timeouts > 5"),
    ("high_text_extract_fail", "warning", "flat > 0 and text_fail > 0.2 * flat"),
    ("many_binary_rejections", "info", "binary_rejections > 50"),
    ("many_external_rejections", "info", "external_rejections > 200"),
    ("saturation_reached", "info", "saturation_enabled and saturated"),
    ("not_saturated", "info", "saturation_enabled and not saturated and flat > 10"),
    ("crawl_failed", "error", "crawl_failed"),
    ("critical_telemetry_events", "error", "critical > 0"),
)
SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}
_BOOLEAN = ("max_pages_reached", "captures", "cms_mismatch", "saturation_enabled", "saturated", "crawl_failed")
_TEXT = {"primary_group": "-"}


def warnings(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, code, severity, severity_rank: one row for each rule that holds. Metrics that are absent count as 0, false, or a group that exists."""
    names = {w for _, _, rule in WARNINGS for w in re.findall(r"[a-z_]+", rule)} - {"and", "not", "div", "or"}
    df = metrics
    for n in sorted(names - set(metrics.columns)):
        df = df.withColumn(n, F.lit(False) if n in _BOOLEAN else F.lit(_TEXT[n]) if n in _TEXT else F.lit(100.0 if n == "average_outlinks" else -1.0 if n == "homepage_sections" else 0.0))
    rules = [F.when(F.expr(rule), F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(SEVERITY_RANK[sev]).alias("severity_rank"))) for i, (code, sev, rule) in enumerate(WARNINGS)]
    return df.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("w")).select(*keys, "w.*")
