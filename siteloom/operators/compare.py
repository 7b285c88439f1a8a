"""Run against run: metric deltas, URLs and parents that changed, verdict, and the gate that accepts or rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import vocab


def long_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value from one row per key with a column for each metric."""
    names = [c for c in metrics.columns if c not in keys]
    return metrics.select(*keys, *(F.col(c).cast("long").alias(c) for c in names)).unpivot(keys, names, "metric", "value")


def metric_deltas(previous: DataFrame, current: DataFrame, keys: list[str], rules=vocab.COMPARED_METRICS) -> DataFrame:
    """keys, metric, previous, current, delta, verdict for the compared metrics; a metric that one run lacks is 0 there.

    A rise from nothing is no regression. Where lower is better a fall from something improves.
    """
    a, b = previous.withColumnRenamed("value", "previous"), current.withColumnRenamed("value", "current")
    df = a.join(b, [*keys, "metric"], "full").na.fill(0, ["previous", "current"])
    low, share = F.lit(None).cast("boolean"), F.lit(None).cast("double")
    for name, lower_is_bad, threshold in rules:
        low, share = F.when(F.col("metric") == name, lower_is_bad).otherwise(low), F.when(F.col("metric") == name, threshold).otherwise(share)
    df = df.withColumn("_low", low).withColumn("_share", share).filter("_share is not null").withColumn("delta", F.col("current") - F.col("previous"))
    part = F.when(F.col("previous") > 0, F.abs(F.col("delta")).cast("double") / F.col("previous")).otherwise(0.0)
    worse, better = F.when(F.col("_low"), F.col("delta") < 0).otherwise(F.col("delta") > 0), F.when(F.col("_low"), F.col("delta") > 0).otherwise((F.col("delta") < 0) & (F.col("previous") > 0))
    out = F.when(worse & (part >= F.col("_share")), "regressed").when(better, "improved").otherwise("unchanged")
    return df.select(*keys, "metric", "previous", "current", "delta", out.alias("verdict"))


def url_changes(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys, url, change (added or removed): URLs, without regard to case, that only one run has, each once in its first spelling."""

    def first(df: DataFrame) -> DataFrame:
        return df.withColumn("_k", F.lower("url")).groupBy(*keys, "_k").agg(F.min("url").alias("url"))

    a, b = first(previous), first(current)
    on = [*keys, "_k"]
    return b.join(a, on, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, on, "left_anti").withColumn("change", F.lit("removed"))).select(*keys, "url", "change")


def parent_changes(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys, url, old_parent, new_parent of pages that both runs have under different parents."""
    a = previous.select(*keys, F.lower("url").alias("_k"), F.coalesce("parent_url", F.lit("")).alias("old_parent")).dropDuplicates([*keys, "_k"])
    b = current.select(*keys, F.lower("url").alias("_k"), "url", F.coalesce("parent_url", F.lit("")).alias("new_parent")).dropDuplicates([*keys, "_k"])
    return a.join(b, [*keys, "_k"]).filter(F.lower("old_parent") != F.lower("new_parent")).select(*keys, "url", "old_parent", "new_parent")


def in_both(previous: DataFrame, current: DataFrame, keys: list[str], col: str = "url") -> DataFrame:
    """keys and the values of a column, lower-cased, that both runs have."""
    one = lambda df: df.select(*keys, F.lower(col).alias(col)).distinct()
    return one(previous).join(one(current), [*keys, col])


def in_either(previous: DataFrame, current: DataFrame, keys: list[str], col: str = "url") -> DataFrame:
    """keys and the values of a column, lower-cased, that either run has."""
    return previous.unionByName(current, allowMissingColumns=True).select(*keys, F.lower(col).alias(col)).distinct()


def report_changes(previous: DataFrame, current: DataFrame, previous_items: DataFrame, current_items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cms_changed, group_changed, changed_parents, common, reviews of reports (keys, cms, primary_group) and items (keys, url, parent_url) of two runs.

    reviews: what somebody has to look at. Names are compared without regard to case, absent ones as empty.
    """
    name = lambda c: F.lower(F.coalesce(c, F.lit("")))
    a = previous.select(*keys, F.col("cms").alias("_c"), F.col("primary_group").alias("_g"))
    moved = parent_changes(previous_items, current_items, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("changed_parents"))
    common = in_both(previous_items, current_items, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("common"))
    df = current.join(a, keys).join(moved, keys, "left").join(common, keys, "left").na.fill(0, ["changed_parents", "common"])
    df = df.withColumn("cms_changed", name(F.col("cms")) != name(F.col("_c"))).withColumn("group_changed", name(F.col("primary_group")) != name(F.col("_g")))
    flags = {"cms_changed": F.col("cms_changed"), "primary_group_changed": F.col("group_changed"), "parents_changed": needs_parent_review(F.col("changed_parents"), F.col("common"))}
    return df.select(*keys, "cms_changed", "group_changed", "changed_parents", "common", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items()))).alias("reviews"))


def needs_parent_review(changed: Column, common: Column) -> Column:
    return changed > F.greatest(F.lit(10), F.floor(common / 5))


def histogram_deltas(previous: DataFrame, current: DataFrame, keys: list[str], name: str, value: str = "n") -> DataFrame:
    """Counts by name, in either run, 0 where it lacks one."""
    a, b = previous.select(*keys, name, F.col(value).alias("previous")), current.select(*keys, name, F.col(value).alias("current"))
    df = a.join(b, [*keys, name], "full").na.fill(0, ["previous", "current"])
    return df.withColumn("delta", F.col("current") - F.col("previous"))


def saturation_change(previous: Column, current: Column) -> Column:
    """Three distinct templates more, or fewer, than before."""
    return F.when(current - previous >= 3, "improved").when(previous - current >= 3, "regressed").otherwise("unchanged")


def overall(regressions: Column, improvements: Column, review: Column) -> Column:
    return (
        F.when((regressions > 0) & (improvements == 0), "regressed").when((improvements > 0) & (regressions == 0), F.when(review > 0, "review").otherwise("improved"))
        .when(review > 0, "review").when((regressions > 0) & (improvements > 0), "review").otherwise("unchanged")
    )


def summarise(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, regressed and improved (sorted arrays of metrics)."""
    pick = lambda v: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("verdict") == v, F.col("metric")))))  # noqa: E731  13 metrics at most
    return deltas.groupBy(*keys).agg(pick("regressed").alias("regressed"), pick("improved").alias("improved"))


CAPTURING = ("snapshot-diagnostic", "full-validation")


def gate(runs: DataFrame) -> DataFrame:
    """runs with decision (accepted, review, rejected), rejections, reviews and exit_code (0, 1, 2); a rejection outweighs a review.

    runs: profile, has_report, quality_errors, flat, regressed, improved, cms_changed, group_changed, cms, nav_groups, tree_nodes,
    fingerprints, saturated, lost_saturation, template_regression, review_flags, url_changes.
    """
    c = F.col
    p = F.lower(F.coalesce(c("profile"), F.lit("")))
    lost = lambda m: F.array_contains("regressed", m)
    won = lambda m: F.array_contains("improved", m)
    nav, smoke, captures = p == "nav-diagnostic", p == "smoke", p.isin(*CAPTURING)
    excused = nav & c("saturated") & (won("orphanPageCount") | won("treeNodeCount") | won("duplicateUrlCount") | won("duplicateTitleCount"))
    reject = {
        "report_missing": ~c("has_report"), "quality_errors": c("quality_errors") > 0, "no_pages": c("flat") == 0, "flatPageCount_regressed": ~smoke & lost("flatPageCount") & ~excused,
        "treeNodeCount_regressed": ~smoke & lost("treeNodeCount"), "pagesCaptured_regressed": ~smoke & captures & lost("pagesCaptured"),
    }
    review = {
        "cms_changed": c("cms_changed"), "flatPageCount_regressed_at_saturation": ~smoke & lost("flatPageCount") & excused, "primary_group_changed": ~smoke & c("group_changed"),
        "orphanPageCount_regressed": ~smoke & lost("orphanPageCount"), "timeoutCount_regressed": ~smoke & lost("timeoutCount"), "failedVisitCount_regressed": ~smoke & lost("failedVisitCount"),
        "snapshotFailCount_regressed": captures & lost("snapshotFailCount"), "no_cms": (p == "cms-diagnostic") & (c("cms") == ""), "no_structure": (p == "cms-diagnostic") & (c("nav_groups") == 0) & (c("tree_nodes") == 0),
        "no_fingerprints": nav & (c("fingerprints") == 0), "lost_saturation": nav & c("lost_saturation"), "template_regression": nav & c("template_regression"),
        "textExtractFailCount_regressed": (p == "snapshot-diagnostic") & lost("textExtractFailCount"), "not_saturated": (p == "full-validation") & ~c("saturated") & (c("fingerprints") > 0),
        "flagged_for_review": ~smoke & (c("review_flags") > 0),
    }
    listed = lambda rules: F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items())))
    df = runs.withColumn("rejections", listed(reject)).withColumn("reviews", listed(review))
    clean = ((F.size("improved") > 0) & (F.size("regressed") == 0)) | ((F.size("regressed") == 0) & (c("url_changes") == 0)) | smoke
    decision = F.when(F.size("rejections") > 0, "rejected").when(F.size("reviews") > 0, "review").when(F.coalesce(clean, F.lit(False)), "accepted").otherwise("review")
    df = df.withColumn("decision", decision)
    return df.withColumn("exit_code", F.when(c("decision") == "accepted", 0).when(c("decision") == "review", 1).otherwise(2))
