"""Navigation hierarchies of many sites at once.

nav items: site_id, ord, url, title, parent_url, depth and flags. Every step is keyed by site_id; the prefix tests of a
page against all pages above it are joins on exploded path prefixes, not nested loops.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls, vocab
from siteloom.operators.classify import evidence, is_utility_page
from siteloom.operators.lineage import EVERY, cut

FLAGS = ("is_external", "is_js_dynamic", "is_display_only", "is_synthetic")


def with_defaults(items: DataFrame) -> DataFrame:
    """Missing strings are empty, missing flags false, missing depths 0; absent columns are added."""
    out = items
    for c in FLAGS:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(False)) if c in items.columns else F.lit(False))
    for c in ("title", "parent_url"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in items.columns else F.lit(""))
    return out.withColumn("depth", F.coalesce(F.col("depth"), F.lit(0)) if "depth" in items.columns else F.lit(0))


def nearest_ancestor(pages: DataFrame, known: DataFrame, start_col: str = "start_url") -> DataFrame:
    """pages (site_id, url, start_url) with ancestor: the nearest path prefix that is a known URL (site_id, url) of the site.

    Null if there is none, or if the start page comes first on the way up.
    """
    ups = pages.select("site_id", F.col("url").alias("_url"), F.col(start_col).alias("_start"), F.posexplode(urls.ancestor_urls(F.col("url"))).alias("_up", "_prefix")).distinct()
    stop = F.min(F.when(F.lower("_prefix") == F.lower("_start"), F.col("_up"))).over(Window.partitionBy("site_id", "_url"))
    ups = ups.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("_up") < F.col("_stop"))).withColumn("_key", F.lower("_prefix"))
    have = known.select("site_id", F.lower("url").alias("_key"), F.col("url").alias("_known"), (F.col("ord") if "ord" in known.columns else F.lit(0)).alias("_ord"))
    have = have.groupBy("site_id", "_key").agg(F.min_by("_known", "_ord").alias("_known"))
    found = ups.join(have, ["site_id", "_key"]).groupBy("site_id", "_url").agg(F.min_by("_known", "_up").alias("ancestor"))
    return pages.join(found.withColumnRenamed("_url", "url"), ["site_id", "url"], "left")


def longest_section(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """pages (site_id, url) with section: the section page (site_id, ord, url) whose path is the longest prefix of the page's.

    Sections are compared without `.html` and page numbers; of equally long ones the first counts; a page is not its own section.
    """
    p = F.lower(urls.normalize_path(urls.path(F.col("url"))))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    ups = F.when(F.size(parts) >= 2, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    exploded = pages.select("site_id", F.col("url").alias("_url"), F.explode(F.transform(ups, lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("_prefix")).distinct()
    own = sections.select("site_id", F.col("url").alias("_section"), F.col("ord").alias("_ord"), F.lower(urls.section_prefix(urls.path(F.col("url")))).alias("_prefix"))
    met = exploded.join(own, ["site_id", "_prefix"]).filter((F.lower("_section") != F.lower("_url")) & urls.same_site_host(urls.host(F.col("_section")), urls.host(F.col("_url"))))
    best = met.groupBy("site_id", "_url").agg(F.min_by("_section", F.struct(-F.length("_prefix"), "_ord")).alias("section"))
    return pages.join(best.withColumnRenamed("_url", "url"), ["site_id", "url"], "left")


def score_url_parent(pages: DataFrame, parent_col: str = "candidate", structural_col: str = "is_structural") -> DataFrame:
    """pages (url, title, start_url, candidate, is_structural) with parent_confidence, parent_accepted and the evidence for and against."""
    u, parent = F.col("url"), F.col(parent_col)
    found = parent.isNotNull()
    safe = F.coalesce(parent, F.lit(""))
    conditions = {
        "ancestor_found": found, "descends": found & urls.is_url_descendant(safe, u), "not_root": found & (F.lower(safe) != F.lower("start_url")), "structural": F.coalesce(F.col(structural_col), F.lit(False)),
        "parent_not_article": found & ~urls.is_dated_or_article_url(safe), "no_cycle": found & ~urls.is_url_descendant(u, safe) & (F.lower(safe) != F.lower(u)),
        "two_segments": urls.path_segment_count(u) >= 2, "child_not_utility": ~is_utility_page(u, F.coalesce(F.col("title"), F.lit(""))),
    }
    return evidence(pages, vocab.PARENT_WEIGHTS, conditions, vocab.PARENT_THRESHOLD, "parent")


def reparent_orphans(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Items below the root get the parent that their path tells: the longest section, else the nearest known page, if the evidence suffices.

    items: site_id, ord, url, title, parent_url, depth, start_url. Returned: the same with parent_url replaced where accepted
    (old_parent_url keeps the old one), candidate, is_structural, parent_confidence and parent_accepted.
    """
    open_ = items.filter((F.lower("parent_url") == F.lower("start_url")) & (F.lower("url") != F.lower("start_url")))
    df = nearest_ancestor(longest_section(open_.select("site_id", "url", "title", "start_url"), sections).distinct(), items)
    df = df.withColumn("candidate", F.coalesce("section", "ancestor"))
    known = sections.select("site_id", F.lower("url").alias("_s")).distinct()
    df = df.withColumn("_s", F.lower("candidate")).join(known.withColumn("is_structural", F.lit(True)), ["site_id", "_s"], "left").withColumn("is_structural", F.coalesce("is_structural", F.lit(False)))
    scored = score_url_parent(df).select("site_id", "url", "candidate", "is_structural", "parent_confidence", "parent_accepted")
    out = items.join(scored.dropDuplicates(["site_id", "url"]), ["site_id", "url"], "left")
    take = F.coalesce("parent_accepted", F.lit(False)) & F.col("candidate").isNotNull()
    return out.withColumn("old_parent_url", F.col("parent_url")).withColumn("parent_url", F.when(take, F.col("candidate")).otherwise(F.col("parent_url")))


def prefix_groups(items: DataFrame) -> DataFrame:
    """site_id, prefix_url, start_url, n_children of the pages below the root that lie two segments deep or more, by the URL one segment up."""
    deep = items.filter((F.lower("parent_url") == F.lower("start_url")) & (F.lower("url") != F.lower("start_url")) & (urls.path_segment_count(F.col("url")) >= 2))
    own = deep.withColumn("prefix_url", urls.immediate_prefix_url(F.col("url"))).filter(F.lower("prefix_url") != F.lower("start_url"))
    first = own.groupBy("site_id", F.lower("prefix_url").alias("_key")).agg(F.min_by("prefix_url", "ord").alias("prefix_url"), F.min_by("start_url", "ord").alias("start_url"), F.count(F.lit(1)).alias("n_children"))
    return first.drop("_key")


def synthetic_candidates(items: DataFrame, known: DataFrame) -> DataFrame:
    """prefix_groups scored as sections that are missing: title, parent_url, synthetic_confidence, synthetic_accepted.

    known: site_id, url of all pages so far. A prefix with a slug that is a number or a date is marked down.
    """
    groups = prefix_groups(items).withColumnRenamed("prefix_url", "url")
    have = known.select("site_id", F.lower("url").alias("_key")).distinct().withColumn("_known", F.lit(True))
    named = items.select("site_id", F.lower("parent_url").alias("_key")).distinct().withColumn("_named", F.lit(True))
    deep = prefix_groups(items).groupBy("site_id").agg(F.sum("n_children").alias("_deep"))
    df = groups.withColumn("_key", F.lower("url")).join(have, ["site_id", "_key"], "left").join(named, ["site_id", "_key"], "left").join(deep, "site_id", "left")
    df = nearest_ancestor(df, known)
    u = F.col("url")
    slug = urls.last_path_segment(u)
    conditions = {
        "prefix_unknown": F.col("_known").isNull(), "two_children": F.col("n_children") >= 2, "referenced": F.col("_named").isNotNull(), "not_dated": ~urls.is_dated_or_article_url(u), "not_binary": ~urls.is_binary_asset(u),
        "not_utility": ~is_utility_page(u, urls.slug_to_title(slug)), "no_cycle": F.lower(F.coalesce("ancestor", "start_url")) != F.lower(u), "shallow": urls.path_segment_count(u) <= 4,
        "ancestor_known": F.col("ancestor").isNotNull(), "deep_root_children": F.coalesce("_deep", F.lit(0)) > 0,
    }
    extra = F.when(urls.is_numeric_or_date_slug(slug), vocab.SLUG_PENALTY).otherwise(0.0)
    df = evidence(df, vocab.SYNTHETIC_WEIGHTS, conditions, vocab.SYNTHETIC_THRESHOLD, "synthetic", extra=extra)
    return df.withColumn("title", urls.slug_to_title(slug)).withColumn("parent_url", F.coalesce("ancestor", "start_url")).drop("_key", "_known", "_named", "_deep", "ancestor")


def insert_synthetic_parents(items: DataFrame) -> DataFrame:
    """Items with the accepted missing sections added, and their children below them.

    Prefixes are taken by depth, shallow first, since a section that is added may be the parent of a deeper one: one pass
    for each depth that occurs.
    """
    items = cut(with_defaults(items))
    depths = [r[0] for r in prefix_groups(items).select(urls.path_segment_count(F.col("prefix_url")).alias("d")).distinct().orderBy("d").collect()]
    out = items
    for d in depths:
        ready = synthetic_candidates(out, out).filter((urls.path_segment_count(F.col("url")) == d) & F.col("synthetic_accepted"))
        made = ready.select("site_id", "url", "title", "parent_url", "start_url")
        keys = made.select("site_id", F.lower("url").alias("_key"), F.col("url").alias("_made"))
        low = F.lower(urls.immediate_prefix_url(F.col("url")))
        moved = out.withColumn("_key", F.when(F.lower("parent_url") == F.lower("start_url"), low)).join(keys, ["site_id", "_key"], "left")
        moved = moved.withColumn("parent_url", F.coalesce("_made", "parent_url")).drop("_key", "_made")
        last = out.groupBy("site_id").agg(F.max("ord").alias("_last"))
        rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.lower("url")))
        new = made.join(last, "site_id").withColumn("ord", (F.col("_last") + rank).cast("long")).withColumn("depth", F.lit(1)).withColumn("is_synthetic", F.lit(True)).drop("_last")
        out = cut(moved.unionByName(new, allowMissingColumns=True))
    return with_defaults(out)


# ---- one row for each URL -----------------------------------------------------------------------------------------


def title_score(title: Column, url: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when(t == "", 0).when((F.lower(t) == F.lower(url)) | F.lower(t).rlike("^https?://"), 1).otherwise(F.least(F.length(t), F.lit(200)))


def row_score(df: DataFrame) -> DataFrame:
    """df with _key and _score: which of several rows of one URL to keep: the root, rows with parents, deeper parents, better titles."""
    df = df.withColumns({"_key": urls.canonical_key(F.col("url")), "_parent": urls.canonical_key(F.col("parent_url")), "_start": urls.canonical_key(F.col("start_url"))})
    df = df.withColumns({"_root": F.col("_key") == F.col("_start"), "_has": (F.col("_parent") != "") & (F.col("_parent") != F.col("_key")) & ~urls.is_url_descendant(F.col("url"), F.col("parent_url")), "_t": title_score(F.col("title"), F.col("url"))})
    root, has = F.col("_root"), F.col("_has")
    score = (
        F.when(root, 10_000).otherwise(0) + F.when(has, 1_000).otherwise(0) + F.when(has & (F.col("_parent") != F.col("_start")), 500).otherwise(0)
        + F.when(~root & (F.col("depth") > 0), 200).otherwise(0) - F.when(~root & (F.col("depth") == 0), 1_000).otherwise(0)
        + 20 * urls.path_segment_count(F.col("parent_url")) + F.least(F.lit(100), F.col("_t"))
    )
    return df.withColumn("_score", score)


def dedup_items(items: DataFrame) -> DataFrame:
    """One row per site and canonical URL: the best row, the best title of all, flags united (display-only only if all are), the first place."""
    df = row_score(with_defaults(items)).filter("_key <> ''")
    kept = ("url", "parent_url", "depth", "start_url")
    out = df.groupBy("site_id", "_key").agg(
        F.max_by(F.struct(*kept), F.struct("_score", (-F.col("ord")).alias("o"))).alias("best"),
        F.max_by("title", F.struct("_t", "_score", (-F.col("ord")).alias("o"))).alias("title"),
        F.max("is_external").alias("is_external"), F.max("is_js_dynamic").alias("is_js_dynamic"), F.min("is_display_only").alias("is_display_only"), F.max("is_synthetic").alias("is_synthetic"), F.min("ord").alias("ord"),
    )
    return out.select("site_id", "ord", urls.canonical_url(F.col("best.url")).alias("url"), "title", urls.canonical_url(F.col("best.parent_url")).alias("parent_url"), "best.depth", "best.start_url", *FLAGS)


def repair_parents(items: DataFrame) -> DataFrame:
    """Parents that are blank, unknown, the page itself or below it become the nearest known ancestor, else the start page; raw titles are resolved."""
    key, parent, start = (urls.canonical_key(F.col(c)) for c in ("url", "parent_url", "start_url"))
    known = items.select("site_id", key.alias("_parent"), F.col("url").alias("_parent_url")).distinct()
    df = nearest_ancestor(items.withColumn("_parent", parent).join(known, ["site_id", "_parent"], "left"), items)
    bad = (F.col("_parent") == "") | (F.col("_parent") == key) | F.col("_parent_url").isNull() | urls.is_url_descendant(F.col("url"), F.col("parent_url"))
    fixed = F.when(key == start, F.lit("")).when(bad, F.coalesce("ancestor", "start_url")).otherwise(F.col("_parent_url"))
    return df.withColumn("parent_url", fixed).withColumn("title", F.when(urls.is_raw_url_title(F.col("title"), F.col("url"), True), urls.display_title(F.col("title"), F.col("url"))).otherwise(F.col("title"))).drop("_parent", "_parent_url", "ancestor")


def recompute_depths(items: DataFrame) -> DataFrame:
    """Depths by parents, the start page 0. Pages that the start page doesn't reach, cycles among them, hang off it at depth 1.

    One join goes down from the roots of all sites at a time, until a level has no page that wasn't reached before, so
    rows of one URL that name different parents don't lead around in circles.
    """
    df = items.withColumn("_key", urls.canonical_key(F.col("url"))).withColumn("_parent", urls.canonical_key(F.col("parent_url"))).withColumn("_start", urls.canonical_key(F.col("start_url")))
    edges = cut(df.filter("_key <> _start and _parent <> _key").select("site_id", "_key", "_parent", "_start"))
    level = edges.filter("_parent = _start").select("site_id", "_key", F.lit(1).alias("_depth")).distinct()
    reached = level
    for d in count(2):
        level = edges.join(level.select("site_id", F.col("_key").alias("_parent")), ["site_id", "_parent"]).select("site_id", "_key").distinct().join(reached.select("site_id", "_key"), ["site_id", "_key"], "left_anti").withColumn("_depth", F.lit(d))
        level = cut(level)
        if level.head() is None:
            break
        reached = reached.unionByName(level)
        if d % EVERY == 0:
            reached = cut(reached)
    best = reached.groupBy("site_id", "_key").agg(F.min("_depth").alias("_depth"))
    out = df.join(best, ["site_id", "_key"], "left")
    root = F.col("_key") == F.col("_start")
    lost = ~root & F.col("_depth").isNull()
    return out.withColumn("parent_url", F.when(lost, F.col("start_url")).otherwise(F.col("parent_url"))).withColumn("depth", F.when(root, 0).when(lost, 1).otherwise(F.col("_depth"))).drop("_key", "_parent", "_start", "_depth")


def finalise(items: DataFrame) -> DataFrame:
    """One row per URL with a valid parent, a readable title and a depth."""
    return recompute_depths(cut(repair_parents(cut(dedup_items(items)))))
