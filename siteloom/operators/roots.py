"""What a site's navigation shows at the top: promotion and seeding of its sections, and which root pages stay visible.

All sites at once, each decided by its own rows. A decision about a site is one row of counters and a rule table over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import classify, frontier
from siteloom.operators.lineage import cut

# Fixed values of the visible-root rules: evidence for a section; orphans that are too many, and how many of the rest that is.
SECTION_SCORE = 0.55
ORPHANS, ORPHANS_PER_ROOT, ORPHANS_PART = 25, 5, 10


def is_likely_section(url: Column, title: Column | None = None) -> Column:
    """Whether a page looks like one of a site's main sections: enough evidence, and no utility, campaign, news or error page."""
    t = F.lit("") if title is None else title
    return (classify.topic_score(url, t) >= SECTION_SCORE) & ~classify.is_utility_page(url, t) & ~classify.is_microsite(url, t) & ~classify.is_news_root(url, t) & ~classify.is_error_root(url, t)


def promoted(primary: DataFrame, visible: DataFrame, accepted: DataFrame) -> DataFrame:
    """site_id, url, ord, source, protected: the pages from which a site's structure starts, each URL once.

    All inputs are (site_id, url, ord). Primary navigation comes first; a site without any has those of its visible links
    that look like sections. Both are protected: they stay below the start page. Accepted homepage links come last and are not.
    """
    none = visible.join(primary.select("site_id").distinct(), "site_id", "left_anti").filter(is_likely_section(F.col("url")))
    found = frontier.seeds([primary, none, accepted])
    return found.withColumn("protected", F.col("source") < 2).withColumn("source", F.element_at(F.array(F.lit("primary"), F.lit("visible"), F.lit("accepted")), F.col("source") + 1))


def seeded(starts: DataFrame, structural: DataFrame, visible: DataFrame, local: DataFrame, sitemap: DataFrame, max_pages: int = 1500, preview: bool = False) -> DataFrame:
    """site_id, url, ord, depth, source, is_structural of the pages that a crawl begins with, each URL once.

    In order: the start page, structural pages (see promoted), visible links, and the site map; sites without structural and
    visible ones begin with their local links instead (structural first, then by confidence). A preview leaves the site map
    out; of it no more are taken than double the budget of pages leaves room for.
    """
    own = lambda df: df.select("site_id", "url", "ord")
    bare = local.join(own(structural).unionByName(own(visible)).select("site_id").distinct(), "site_id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("is_structural"), F.desc("confidence"), "ord"))
    bare = bare.withColumn("ord", rank)
    sources = [own(starts), own(structural), own(visible), own(bare)] + ([] if preview else [own(sitemap)])
    found = frontier.seeds([s.withColumn("ord", F.col("ord").cast("long")) for s in sources])
    flags = bare.groupBy("site_id", F.lower("url").alias("_key")).agg(F.max("is_structural").alias("_s"))
    found = found.withColumn("_key", F.lower("url")).join(flags, ["site_id", "_key"], "left").drop("_key")
    kind = F.when(F.col("source") <= 1, True).when(F.col("source") == 3, F.coalesce("_s", F.lit(False))).otherwise(False)
    found = found.withColumn("is_structural", kind).withColumn("depth", F.when(F.col("source") == 0, 0).otherwise(1)).drop("_s")
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("source", "ord"))
    found = found.withColumn("ord", place - 1).filter((F.col("source") < 4) | (F.col("ord") < 2 * max_pages))
    return found.withColumn("source", F.element_at(F.array(*(F.lit(x) for x in ("start", "structural", "visible", "local", "sitemap"))), F.col("source") + 1))


# ---- which root pages stay visible --------------------------------------------------------------------------------


def first_accepted_ancestor(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """items (site_id, url, start_url) with accepted_ancestor: of the accepted pages (site_id, url, ord) above it by path the first by ord, not the nearest."""
    ups = items.select("site_id", F.col("url").alias("_url"), F.col("start_url").alias("_start"), F.explode(urls.ancestor_urls(F.col("url"))).alias("_up")).distinct()
    own = accepted.select("site_id", urls.canonical_key(F.col("url")).alias("_k"), F.col("url").alias("_accepted"), F.col("ord").alias("_o"))
    met = ups.withColumn("_k", urls.canonical_key(F.col("_up"))).join(own, ["site_id", "_k"]).filter((F.lower("_accepted") != F.lower("_start")) & (F.lower("_accepted") != F.lower("_url")))
    first = met.groupBy("site_id", "_url").agg(F.min_by("_accepted", "_o").alias("accepted_ancestor"))
    return items.join(first.withColumnRenamed("_url", "url"), ["site_id", "url"], "left")


def _keyed(items: DataFrame) -> DataFrame:
    key = lambda c: F.coalesce(urls.canonical_key(F.col(c)), F.lit(""))
    return items.withColumn("_k", key("url")).withColumn("_p", key("parent_url")).withColumn("_s", key("start_url"))


def hidden_root_count(flat: DataFrame, tree: DataFrame) -> DataFrame:
    """site_id, crawlable_not_visible: root pages of the flat list (site_id, url, parent_url, start_url) that aren't root pages of the tree."""
    root = (F.col("_p") == F.col("_s")) & (F.col("_k") != F.col("_s"))
    shown = _keyed(tree).filter(F.col("_p") == F.col("_s")).select("site_id", "_k").distinct()
    n = _keyed(flat).filter(root).select("site_id", "_k").distinct().join(shown, ["site_id", "_k"], "left_anti").groupBy("site_id").agg(F.count(F.lit(1)).alias("crawlable_not_visible"))
    return flat.select("site_id").distinct().join(n, "site_id", "left").select("site_id", F.coalesce("crawlable_not_visible", F.lit(0)).alias("crawlable_not_visible"))


def visible_roots(tree: DataFrame, flat: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree's items that stay visible, and a row of counters and the reason for each site.

    tree, flat: site_id, url, parent_url, start_url, ord. candidates: site_id, url, ord, accepted of homepage links. Root
    pages that were not accepted go, unless one of seven reasons keeps the whole tree as it is: no accepted links, too few of
    them, none or too few among the root pages, or a result that is empty, collapsed or leaves masses of orphans. What hung
    below a page that went moves to the first accepted page above it by path; without one it is an orphan and goes, too.
    A URL may have several rows: each is judged by its own parent and ord and counts as an orphan of its own, the last of
    those that stay is shown. Root pages count once for each URL.
    """
    own = cut(_keyed(tree).filter("_k <> ''"))
    accepted = candidates.filter("accepted").groupBy("site_id", urls.canonical_key(F.col("url")).alias("_k")).agg(F.min_by("url", "ord").alias("url"), F.min("ord").alias("ord")).filter("_k <> ''")
    yes = accepted.select("site_id", "_k", F.lit(True).alias("_yes"))
    is_start, is_root = F.col("_k") == F.col("_s"), (F.col("_p") == F.col("_s")) & (F.col("_k") != F.col("_s"))
    keys = own.groupBy("site_id", "_k").agg(F.max(is_root).alias("_root")).join(yes, ["site_id", "_k"], "left").withColumn("_yes", F.coalesce("_yes", F.lit(False)))
    keys = cut(keys.withColumn("_gone", F.col("_root") & ~F.col("_yes")))
    gone = keys.filter("_gone").select("site_id", "_k", "_gone")
    own = cut(first_accepted_ancestor(own, accepted).join(gone, ["site_id", "_k"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(False))))

    # Visible for sure: the start page, and what an accepted page is above. The rest is visible below what is visible, if that comes first.
    first = lambda df: df.groupBy("site_id", "_k").agg(F.min("ord").alias("ord"))
    visible = cut(first(own.filter(is_start | (~F.col("_gone") & F.col("accepted_ancestor").isNotNull()))))
    open_ = own.filter(~is_start & ~F.col("_gone") & F.col("accepted_ancestor").isNull())
    level = visible
    while True:
        above = level.select("site_id", F.col("_k").alias("_p"), F.col("ord").alias("_o"))
        earlier = visible.select("site_id", "_k", F.col("ord").alias("_o"))
        level = cut(first(open_.join(above, ["site_id", "_p"]).filter("_o < ord")).join(earlier, ["site_id", "_k"], "left").filter("_o is null or ord < _o").select("site_id", "_k", "ord"))
        if level.head() is None:
            break
        visible = cut(first(visible.unionByName(level)))
    above = visible.select("site_id", F.col("_k").alias("_p"), F.col("ord").alias("_o"))
    judged = own.filter(is_start | ~F.col("_gone")).join(above, ["site_id", "_p"], "left").withColumn("_kept", is_start | F.coalesce(F.col("_o") < F.col("ord"), F.lit(False)))
    judged = cut(judged.withColumn("_lost", ~F.col("_kept") & F.col("accepted_ancestor").isNull()))
    shown = judged.filter("not _lost").withColumn("parent_url", F.when(F.col("_kept"), F.col("parent_url")).otherwise(F.col("accepted_ancestor")))
    shown = shown.groupBy("site_id", "_k").agg(F.max_by(F.struct(*(F.col(c) for c in tree.columns if c != "site_id"), "_s"), "ord").alias("r")).select("site_id", "_k", "r.*")
    shown = cut(shown.withColumn("_p", F.coalesce(urls.canonical_key(F.col("parent_url")), F.lit(""))))

    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    before = keys.groupBy("site_id").agg(count(F.col("_root"), "roots_before"), count(F.col("_root") & F.col("_yes"), "overlap"), count(F.col("_gone"), "suppressed"))
    no = candidates.filter("not accepted").select("site_id", urls.canonical_key(F.col("url")).alias("_k")).distinct()
    rejected = gone.join(no, ["site_id", "_k"], "left_semi").groupBy("site_id").agg(F.count(F.lit(1)).alias("rejected_suppressed"))
    after = shown.groupBy("site_id").agg(count(is_root, "roots_after"))
    lost = judged.filter("_lost").groupBy("site_id").agg(F.count(F.lit(1)).alias("orphaned"))
    size = flat.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_flat"))
    report = before.join(accepted.groupBy("site_id").agg(F.count(F.lit(1)).alias("accepted")), "site_id", "left")
    for more in (after, lost, rejected, size):
        report = report.join(more, "site_id", "left")
    report = report.na.fill(0)
    b, a, n, o, lap = (F.col(c) for c in ("roots_before", "roots_after", "accepted", "orphaned", "overlap"))
    half = F.floor(b / 2)
    rules = (
        (n == 0, "no_accepted_homepage_anchors"), ((n < 2) & (b >= 3), "sparse_homepage_anchors"), ((lap == 0) & (b > 0), "homepage_anchors_do_not_overlap_primary_roots"),
        ((b >= 4) & (lap > 0) & (lap < F.least(F.lit(2), n)), "homepage_anchors_low_overlap_with_primary_roots"), (a == 0, "suppression_would_empty_navigation"),
        ((b >= 3) & (a < F.greatest(F.lit(2), half)), "suppression_would_collapse_visible_roots"),
        ((o >= ORPHANS) & (o > F.greatest(a * ORPHANS_PER_ROOT, F.floor(F.col("n_flat") / ORPHANS_PART))), "suppression_would_massively_orphan_descendants"),
    )
    reason = F.lit("")
    for rule, name in reversed(rules):
        reason = F.when(rule, name).otherwise(reason)
    report = cut(report.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "applied").otherwise("skipped")))
    applied = report.filter("status = 'applied'").select("site_id")
    columns = tree.columns
    whole = F.coalesce(F.col("parent_url"), F.lit(""))
    kept = shown.join(applied, "site_id", "left_semi").select(columns).unionByName(tree.join(applied, "site_id", "left_anti").select(columns))
    kept = kept.withColumn("parent_url", whole)
    hidden = hidden_root_count(flat, kept)
    early = F.col("reason").isin(*(name for _, name in rules[:4]))  # decided before anything is taken out
    report = report.withColumn("roots_after", F.when(early, b).otherwise(a)).withColumn("orphaned", F.when(early, 0).otherwise(o)).join(hidden, "site_id", "left")
    numbers = ("accepted", "overlap", "roots_before", "roots_after", "suppressed", "rejected_suppressed", "orphaned", "crawlable_not_visible")
    return kept, report.select("site_id", "status", "reason", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers))


def annotated_roots(tree: DataFrame, accepted: DataFrame, protected: DataFrame) -> DataFrame:
    """The tree's items, unchanged, with what a root page is: root_kind, root_eligible, root_confidence, root_reason, bucket; null for other pages.

    accepted, protected: site_id, url of accepted homepage links and of primary navigation.
    """
    df = _keyed(tree)
    has = lambda t, name: t.select("site_id", urls.canonical_key(F.col("url")).alias("_k"), F.lit(True).alias(name)).distinct()
    parents = df.select("site_id", F.col("_p").alias("_k"), F.lit(True).alias("_children")).distinct()
    for t in (has(accepted, "_accepted"), has(protected, "_primary"), parents):
        df = df.join(t, ["site_id", "_k"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in tree.columns else F.lit("")
    flags = {"primary_nav": flag("_primary"), "homepage_anchor": flag("_accepted"), "has_children": flag("_children")} | ({"is_synthetic": flag("is_synthetic")} if "is_synthetic" in tree.columns else {})
    is_root = (F.col("_p") == F.col("_s")) & (F.col("_k") != F.col("_s"))
    df = df.withColumn("_c", F.when(is_root, classify.root_class(F.col("url"), title, F.col("start_url"), flags)))
    bucket = F.when(is_root, classify.viewer_bucket(F.col("_c.kind"), classify.is_utility_page(F.col("url"), title)))
    return df.select(*tree.columns, F.col("_c.kind").alias("root_kind"), F.col("_c.eligible").alias("root_eligible"), F.col("_c.confidence").alias("root_confidence"), F.col("_c.reason").alias("root_reason"), bucket.alias("bucket"))


def synced(tree: DataFrame, flat: DataFrame) -> DataFrame:
    """The tree as the corrected flat list now has it: that list's rows whose page is in the tree. Sites without any have their whole flat list."""
    keys = _keyed(tree).filter("_k <> ''").select("site_id", "_k").distinct()
    both = _keyed(flat).join(keys.withColumn("_in", F.lit(True)), ["site_id", "_k"], "left")
    some = both.filter("_in").select("site_id").distinct().withColumn("_some", F.lit(True))
    return both.join(some, "site_id", "left").filter("_in or _some is null").select(*flat.columns)
