"""Registered queries: each applies operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import text, urls
from siteloom.operators import classify, compare, dom, fingerprint, frontier, hierarchy, links, navigation, quality, roots, tree, viewer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a navigation item below the start page of its site."""
    u = F.col("url")
    site = F.concat(urls.scheme(u), F.lit("://"), urls.host(u))
    return pages(spark, sf_dir).select(site.alias("site_id"), F.col("page_id").alias("ord"), urls.canonical_url(u).alias("url"), text.page_title(F.col("html")).alias("title"), site.alias("parent_url"), F.lit(1).alias("depth"), site.alias("start_url"))


def _u():
    return F.col("url")


def url_normalize(s, d):
    return pages(s, d).select("page_id", urls.normalize_url(_u(), True).alias("no_query"), urls.normalize_url(_u(), False).alias("with_query"), urls.ensure_scheme(F.regexp_replace(_u(), "^https://", "")).alias("with_scheme"))


def url_canonical_key(s, d):
    return pages(s, d).select("page_id", urls.canonical_key(_u()).alias("url_key"), urls.host_to_site_name(urls.host(_u())).alias("site_name"))


def url_segments(s, d):
    return pages(s, d).select("page_id", urls.path_segment_count(_u()).cast("long").alias("n_segments"), urls.last_path_segment(_u()).alias("last_segment"), urls.immediate_prefix_url(_u()).alias("prefix_url"), urls.section_prefix(urls.path(_u())).alias("section"))


def url_path_shape(s, d):
    return pages(s, d).select("page_id", urls.path_shape(_u()).alias("shape"))


def page_file_key(s, d):
    return pages(s, d).select("page_id", urls.page_file_key(_u()).alias("file_key"))


def url_predicates(s, d):
    p = urls.path(_u())
    return pages(s, d).select(
        "page_id", urls.is_http_url(_u()).alias("http"), urls.is_binary_asset(_u()).alias("binary"), urls.is_noise_path(p).alias("noise"), urls.is_dated_or_article_url(_u()).alias("article"),
        urls.is_display_only(_u(), F.regexp_replace(urls.host(_u()), "^(www|m|blog)[.]", "")).alias("display_only"), urls.is_numeric_or_date_slug(urls.last_path_segment(_u())).alias("numeric_slug"), urls.is_start_page_alias(_u(), _u()).alias("start_alias"),
    )


def same_site_host(s, d):
    bare = F.regexp_replace(urls.host(_u()), "^(www|m)[.]", "")
    return pages(s, d).select("page_id", urls.same_site_host(urls.host(_u()), bare).alias("same_site"), urls.is_url_descendant(F.concat(F.lit("http://"), bare, F.lit("/en")), _u()).alias("below_en"))


def page_title(s, d):
    return pages(s, d).select("page_id", text.page_title(F.col("html")).alias("title"))


def display_title(s, d):
    title = F.when(F.col("page_id") % 2 == 0, text.page_title(F.col("html"))).otherwise(_u())
    return pages(s, d).select("page_id", urls.display_title(title, _u()).alias("display"), urls.display_title_reason(title, _u()).alias("reason"), urls.slug_to_title(urls.last_path_segment(_u())).alias("slug_title"))


def anchor_extract(s, d):
    return links.anchors(pages(s, d)).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "text")


def link_classify(s, d):
    return links.classified(links.anchors(pages(s, d))).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "reason")


def link_reject_histogram(s, d):
    return links.reject_histogram(links.classified(links.anchors(pages(s, d))))


def cms_detect(s, d):
    c = pages(s, d).select("page_id", classify.detect_cms(F.col("html")).alias("c"))
    return c.select("page_id", F.col("c.kind").alias("cms"), "c.confidence", F.size("c.signals").cast("long").alias("n_signals"))


def content_type(s, d):
    c = pages(s, d).select("page_id", classify.content_type(urls.path(_u()), text.page_title(F.col("html"))).alias("c"))
    return c.select("page_id", "c.content_type", "c.confidence")


def template_fingerprint(s, d):
    return fingerprint.fingerprints(pages(s, d)).select("page_id", "path_shape", "content_type", "heading_shape", "section_bucket", "fingerprint")


def root_class(s, d):
    i = items(s, d)
    c = classify.root_class(_u(), F.col("title"), F.col("start_url"), {"has_children": F.col("ord") % 2 == 0, "primary_nav": F.col("ord") % 3 == 0})
    i = i.select(F.col("ord").alias("page_id"), c.alias("c"), F.round(classify.topic_score(_u(), F.col("title")), 6).alias("topic_score"))
    return i.select("page_id", "c.kind", "c.eligible", F.round("c.confidence", 6).alias("confidence"), "topic_score")


def root_topology_by_site(s, d):
    return quality.root_topology(items(s, d))


def duplicate_titles(s, d):
    return quality.duplicate_groups(items(s, d), F.col("title"), "n_groups")


def duplicate_urls(s, d):
    return quality.duplicate_groups(items(s, d).withColumn("url", urls.immediate_prefix_url(_u())), _u(), "n_groups")


def orphan_pages(s, d):
    i = items(s, d).withColumn("parent_url", F.when(F.col("ord") % 3 == 0, F.col("start_url")).otherwise(urls.immediate_prefix_url(_u())))
    return quality.orphans(i).select("site_id", "url", "parent_url", F.col("ord").alias("page_id"))


def _known(s, d):
    """Known pages: all sections that the addresses of pages name, and the pages."""
    i = items(s, d)
    return i.select("site_id", "url", "ord").unionByName(i.select("site_id", urls.immediate_prefix_url(_u()).alias("url"), "ord").filter("url is not null"))


def nearest_ancestor(s, d):
    return hierarchy.nearest_ancestor(items(s, d), _known(s, d)).select(F.col("ord").alias("page_id"), "ancestor")


def section_join(s, d):
    sections = _known(s, d).groupBy("site_id", "url").agg(F.min("ord").alias("ord"))
    return hierarchy.longest_section(items(s, d), sections).select(F.col("ord").alias("page_id"), "section")


def url_parent_score(s, d):
    df = hierarchy.nearest_ancestor(items(s, d), _known(s, d)).withColumnRenamed("ancestor", "candidate").withColumn("is_structural", F.col("ord") % 2 == 0)
    return hierarchy.score_url_parent(df).select(F.col("ord").alias("page_id"), F.round("parent_confidence", 6).alias("confidence"), F.col("parent_accepted").alias("accepted"))


def synthetic_parents(s, d):
    i = items(s, d)
    return hierarchy.synthetic_candidates(i, i).select("site_id", F.col("url").alias("prefix_url"), "n_children", F.round("synthetic_confidence", 6).alias("confidence"), F.col("synthetic_accepted").alias("accepted"), "title", "parent_url")


def depth_recalc(s, d):
    return hierarchy.recompute_depths(hierarchy.insert_synthetic_parents(items(s, d))).select("site_id", "url", "parent_url", "depth", "is_synthetic")


def dedup_best_row(s, d):
    i = items(s, d).withColumn("url", urls.immediate_prefix_url(_u())).withColumn("depth", (F.col("ord") % 3).cast("int")).withColumn("is_display_only", F.col("ord") % 2 == 0)
    return hierarchy.dedup_items(i).select("site_id", "url", "title", F.col("ord").alias("first_ord"), "is_display_only", "depth")


def tree_preorder(s, d):
    return tree.preorder(hierarchy.insert_synthetic_parents(items(s, d))).select("site_id", F.col("pos").cast("long").alias("pos"), "url", "prev_url", "next_url")


def spread_sample(s, d):
    return links.spread_sample(links.anchors(pages(s, d)), ["page_id"], ["pos"], 4, "href").select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def link_cap(s, d):
    return links.capped(links.anchors(pages(s, d)), ["page_id"], ["pos"], 3).select("page_id", F.col("pos").cast("long").alias("pos"))


def depth_cap(s, d):
    i = items(s, d).withColumn("depth", urls.path_segment_count(_u()) + (F.col("ord") % 2).cast("int"))
    return links.capped(i, ["site_id", "depth"], ["ord"], 3).select(F.col("ord").alias("page_id"), "depth")


def frontier_bfs(s, d):
    """A crawl of all sites over their own links, within the operator's own budgets."""
    found = links.internal(links.classified(links.anchors(pages(s, d))))
    site = F.concat(urls.scheme(_u()), F.lit("://"), urls.host(_u()))
    own = found.select(site.alias("site_id"), urls.canonical_url(F.col("page_url")).alias("url"), urls.canonical_url(_u()).alias("target"), F.struct("page_id", "pos").alias("pos"))
    starts = own.groupBy("site_id").agg(F.min_by("url", "pos").alias("url"))
    return frontier.crawl(starts, own).select("site_id", "url", "depth", "ord")


def text_sections(s, d):
    found = dom.sections(dom.readable(dom.blocks(pages(s, d))))
    return found.select("page_id", "section", "heading", "level", F.size("content").alias("n_blocks"))


def dom_links(s, d):
    return links.best_by_confidence(dom.scored_links(dom.links(pages(s, d))).withColumnRenamed("href", "url")).select("page_id", "url", "container", F.round("confidence", 6).alias("confidence"), "is_structural")


def structural_links(s, d):
    found = navigation.structural_links(navigation.placed_links(pages(s, d)), F.lit(True))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "name", "kind", F.round("confidence", 6).alias("confidence"))


def local_links(s, d):
    found = navigation.local_links(navigation.placed_links(pages(s, d)))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "name", "kind", "confidence", "is_structural", F.col("rank").cast("long").alias("rank"))


def likely_sections(s, d):
    return items(s, d).select(F.col("ord").alias("page_id"), roots.is_likely_section(_u(), F.col("title")).alias("likely"))


def link_attachment(s, d):
    """What each internal link makes of its page and its target: attached, structural, under which parent; the first three links of a page are structural."""
    found = links.internal(links.classified(links.anchors(pages(s, d))))
    parent, child = urls.canonical_url(F.col("page_url")), urls.canonical_url(_u())
    start, structural, no = F.concat(urls.scheme(parent), F.lit("://"), urls.host(parent)), F.col("pos") < 3, F.lit(False)
    is_child = frontier.is_structural_child(parent, child, start, F.lit(True), structural, no)
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), frontier.should_attach(parent, child, start, no, structural).alias("attached"), is_child.alias("is_structural"), frontier.resolve_parent(parent, child, start, F.lit(True), is_child, no).alias("parent"), frontier.should_upgrade(start, parent, no, structural, start).alias("upgrades"))


def _tree(s, d):
    """The site trees with missing sections, and the start pages."""
    t = hierarchy.insert_synthetic_parents(items(s, d)).select("site_id", "url", "parent_url", "start_url", F.col("ord").cast("long").alias("ord"))
    starts = items(s, d).groupBy("site_id").agg(F.first("start_url").alias("start_url")).select("site_id", F.col("start_url").alias("url"), F.lit("").alias("parent_url"), "start_url", F.lit(-1).cast("long").alias("ord"))
    return t.unionByName(starts)


def _candidates(s, d):
    """Sections of each site as homepage links; all but one language's are accepted."""
    sections = items(s, d).select("site_id", urls.immediate_prefix_url(_u()).alias("url"), "ord").filter("url is not null").groupBy("site_id", "url").agg(F.min("ord").alias("ord"))
    return sections.withColumn("accepted", urls.last_path_segment(_u()) != "en")


def visible_root_report(s, d):
    t = _tree(s, d)
    return roots.visible_roots(t, t, _candidates(s, d))[1]


def visible_tree(s, d):
    t = _tree(s, d)
    return roots.visible_roots(t, t, _candidates(s, d))[0].select("site_id", "url", "parent_url")


def accepted_ancestor(s, d):
    return roots.first_accepted_ancestor(items(s, d), _candidates(s, d).filter("accepted")).select(F.col("ord").alias("page_id"), "accepted_ancestor")


def page_files(s, d):
    return viewer.page_files(items(s, d))


def ordered_children(s, d):
    i = items(s, d).withColumn("parent_url", urls.immediate_prefix_url(_u())).filter("parent_url is not null")
    return viewer.ordered_children(i).select(F.col("ord").alias("page_id"), F.col("place").cast("long").alias("place"))


def seed_subtrees(s, d):
    t = _tree(s, d)
    return viewer.seed_subtrees(t.filter("ord = -1").select("site_id", "url"), t).select("site_id", "url", "level")


def slug_words(s, d):
    return pages(s, d).select("page_id", urls.humanized_slug(_u()).alias("words"))


# ---- events -------------------------------------------------------------------------------------------------------

def _k():
    return F.expr("try_cast(get_json_object(props, '$.k') as int)")


def event_counters(s, d):
    t = F.col("event_type")
    return quality.event_counters(events(s, d), ["user_id"], {"views": t == "view", "errors": t == "error", "purchases": (t == "purchase") & (F.col("value") > 5)})


def distinct_patterns(s, d):
    return events(s, d).groupBy("user_id").agg(F.countDistinct("event_type").alias("n_types"), F.countDistinct(_k()).alias("n_k"))


def json_field_histogram(s, d):
    return events(s, d).groupBy(_k().alias("k")).agg(F.count(F.lit(1)).alias("n"))


def first_seen_top20(s, d):
    e = events(s, d).withColumn("pattern", F.concat("event_type", F.lit(":"), _k().cast("string")))
    return quality.first_seen(e, ["event_type"], "pattern", ["user_id"], "event_id", 20).select("event_type", "pattern", "n", "first_ord", "user_id", F.col("rank").cast("long").alias("rank"))


def saturation_by_user(s, d):
    e = events(s, d).withColumn("k", (_k() % 10).cast("string"))
    return quality.saturation(e, ["user_id"], ["event_type", "k"], 20, "event_id")


def until_saturated(s, d):
    e = events(s, d).withColumn("k", (_k() % 10).cast("string"))
    return quality.until_saturated(e, ["user_id"], ["event_type", "k"], 5, "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("pages"), F.max("event_id").alias("last_event"))


def novelty_flags(s, d):
    e = events(s, d).withColumn("k", (_k() % 10).cast("string"))
    return quality.novelty(e, ["user_id"], ["event_type", "k"], "event_id").select("event_id", "is_new")


def average_rounded(s, d):
    return events(s, d).groupBy("event_type").agg(F.bround(F.avg(_k()), 1).alias("average"), F.max_by("event_id", "ts").alias("last_event"))


def events_by_hour(s, d):
    return events(s, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


# ---- run against run ----------------------------------------------------------------------------------------------


def _halves(s, d):
    e = events(s, d)
    return e.filter("ts < timestamp'2024-01-16'"), e.filter("ts >= timestamp'2024-01-16'")


#: What stands for the metrics of a run here: counts of a user's events.
_EVENT_RULES = (("view", True, 0.10), ("click", True, 0.20), ("purchase", True, 0.15), ("error", False, 0.20), ("signup", False, 0.30))


def _metric_deltas(s, d):
    count = lambda e: e.groupBy("user_id", F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    a, b = _halves(s, d)
    return compare.metric_deltas(count(a), count(b), ["user_id"], _EVENT_RULES)


def run_metric_delta(s, d):
    return _metric_deltas(s, d)


def run_verdict(s, d):
    m = compare.summarise(_metric_deltas(s, d), ["user_id"])
    return m.select("user_id", F.array_join("regressed", ",").alias("regressed"), F.array_join("improved", ",").alias("improved"), compare.overall(F.size("regressed"), F.size("improved"), F.lit(0)).alias("verdict"))


def urls_added_removed(s, d):
    i = items(s, d).withColumn("url", urls.immediate_prefix_url(_u()))
    return compare.url_changes(i.filter("ord % 2 = 0"), i.filter("ord % 2 = 1"), ["site_id"])


def parent_changes(s, d):
    i = items(s, d).withColumn("url", urls.immediate_prefix_url(_u()))
    one = lambda df: df.groupBy("site_id", "url").agg(F.concat(F.lit("p"), (F.min("ord") % 5).cast("string")).alias("parent_url"))
    return compare.parent_changes(one(i.filter("ord % 2 = 0")), one(i.filter("ord % 2 = 1")), ["site_id"])


def report_changes(s, d):
    """Sections of the event log as reports: the user's first event type before and after the middle is the cms, its last one the primary group."""
    a, b = _halves(s, d)
    report = lambda e: e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("cms"), F.max_by("event_type", "event_id").alias("primary_group"))
    items_ = lambda e: e.groupBy("user_id", F.col("event_type").alias("url")).agg(F.concat(F.lit("p"), (F.min("event_id") % 3).cast("string")).alias("parent_url"))
    found = compare.report_changes(report(a), report(b), items_(a), items_(b), ["user_id"])
    return found.select("user_id", "cms_changed", "group_changed", "changed_parents", "common", F.array_join("reviews", ",").alias("reviews"))


def acceptance_decision(s, d):
    m = compare.summarise(_metric_deltas(s, d), ["user_id"])
    profile = F.element_at(F.array(*(F.lit(x) for x in ("smoke", "cms-diagnostic", "nav-diagnostic", "snapshot-diagnostic", "full-validation"))), (F.col("user_id") % 5 + 1).cast("int"))
    as_metric = lambda c: F.transform(c, lambda x: F.when(x == "view", "flatPageCount").when(x == "click", "treeNodeCount").when(x == "error", "timeoutCount").when(x == "purchase", "pagesCaptured").otherwise(x))
    u = F.col("user_id")
    runs = m.select(
        "user_id", profile.alias("profile"), F.lit(True).alias("has_report"), (u % 11 == 0).cast("int").alias("quality_errors"), (u % 13).alias("flat"), as_metric("regressed").alias("regressed"), as_metric("improved").alias("improved"),
        (u % 7 == 0).alias("cms_changed"), F.lit(False).alias("group_changed"), F.lit("x").alias("cms"), F.lit(1).alias("nav_groups"), F.lit(1).alias("tree_nodes"), F.lit(1).alias("fingerprints"), (u % 2 == 0).alias("saturated"),
        F.lit(False).alias("lost_saturation"), F.lit(False).alias("template_regression"), F.lit(0).alias("review_flags"), (u % 3).alias("url_changes"),
    )
    return compare.gate(runs).select("user_id", "decision", "exit_code")


def _site_metrics(s, d):
    """What the warning rules look at, for each site, as far as its pages and links tell it; the tree's nodes are its sections."""
    i = items(s, d)
    site = F.concat(urls.scheme(F.col("page_url")), F.lit("://"), urls.host(F.col("page_url")))
    found = links.classified(links.anchors(pages(s, d))).groupBy(site.alias("site_id")).agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason") == "external_host").alias("external_rejections"), F.count_if(F.col("reason") == "binary_asset").alias("binary_rejections")
    )
    flat = i.groupBy("site_id").agg(F.count(F.lit(1)).alias("flat"), F.count_if(F.trim("title") == "").alias("empty_titles"), F.max(urls.path_segment_count(_u())).alias("max_depth"), F.countDistinct(urls.immediate_prefix_url(_u())).alias("tree_nodes"))
    lost = quality.orphans(i.withColumn("parent_url", urls.immediate_prefix_url(_u()))).groupBy("site_id").agg(F.count(F.lit(1)).alias("orphans"))
    same = quality.duplicate_groups(i, F.col("title"), "duplicate_titles")
    m = flat
    for more in (quality.root_topology(i).drop("verdict"), found, lost, same):
        m = m.join(more, "site_id", "left")
    m = m.na.fill(0)
    return m.withColumn("average_outlinks", F.bround(F.col("accepted") / F.col("flat"), 1)).withColumn("nav_groups", F.lit(1))


def quality_warnings(s, d):
    return quality.warnings(_site_metrics(s, d), ["site_id"]).select("site_id", "code", "severity")


def stream_saturation(s, d):
    """Saturation by user over the event table read as a stream."""
    import uuid

    from siteloom.operators.lineage import shared_folder
    from siteloom.streaming import events as st

    e = s.readStream.schema(events(s, d).schema).parquet(d + "/events.parquet*")
    own = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("ord"), "event_type", (_k() % 10).cast("string").alias("k"))
    return st.latest(st.run_once(st.saturation(own, ["event_type", "k"], 20), "update", f"{shared_folder(s)}/stream-{uuid.uuid4().hex[:12]}"), ["run_id"])


QUERIES: tuple[Callable, ...] = (
    url_normalize, url_canonical_key, url_segments, url_path_shape, page_file_key, url_predicates, same_site_host, page_title, display_title, anchor_extract, link_classify, link_reject_histogram,
    cms_detect, content_type, template_fingerprint, root_class, root_topology_by_site, duplicate_titles, duplicate_urls, orphan_pages, nearest_ancestor, section_join, url_parent_score, synthetic_parents,
    depth_recalc, dedup_best_row, tree_preorder, spread_sample, link_cap, depth_cap, frontier_bfs, text_sections, dom_links, structural_links, local_links, likely_sections, link_attachment, visible_root_report, visible_tree,
    accepted_ancestor, page_files, ordered_children, seed_subtrees, slug_words, event_counters, distinct_patterns, json_field_histogram, first_seen_top20, saturation_by_user, until_saturated,
    novelty_flags, average_rounded, events_by_hour, run_metric_delta, run_verdict, urls_added_removed, parent_changes, report_changes, acceptance_decision, quality_warnings, stream_saturation,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
