"""Orders, files and subtrees that a site's viewer shows, and how its run went."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators.lineage import cut

#: Place of root pages that the homepage doesn't link to.
NO_PLACE = 9999


def ranked_groups(groups: DataFrame) -> DataFrame:
    """Navigation groups (site_id, group_id, rank, n_links) with `place` from 1: lower ranks first, of equal ones the larger. The first is the primary one."""
    w = Window.partitionBy("site_id").orderBy("rank", F.desc("n_links"), "group_id")
    return groups.withColumn("place", F.row_number().over(w)).withColumn("is_primary", F.col("place") == 1)


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Visible groups (site_id, group_order, label) with `place` from 1, by order, then label."""
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy("group_order", F.lower("label"), "label")))


def ordered_children(items: DataFrame) -> DataFrame:
    """Items (site_id, url, parent_url, depth, title, and ord if there is one) with `place` from 1 among those of the same parent, by depth, then title; rows of one URL by ord."""
    own = ["ord"] if "ord" in items.columns else []
    return items.withColumn("place", F.row_number().over(Window.partitionBy("site_id", F.lower("parent_url")).orderBy("depth", F.lower("title"), "url", *own)))


def ordered_roots(roots: DataFrame, homepage: DataFrame) -> DataFrame:
    """Root pages (site_id, url, ord) with `place` from 1: as the homepage (site_id, url, dom_order) has them, then the others in their own order."""
    own = homepage.groupBy("site_id", urls.canonical_key(F.col("url")).alias("_k")).agg(F.min("dom_order").alias("_at"))
    df = roots.withColumn("_k", urls.canonical_key(F.col("url"))).join(own, ["site_id", "_k"], "left").withColumn("dom_order", F.coalesce("_at", F.lit(NO_PLACE)))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy("dom_order", "ord"))).drop("_k", "_at")


def page_files(items: DataFrame, drop_query: bool = True) -> DataFrame:
    """site_id, url, file: the file of each page of the flat list (site_id, url, ord); pages of a www host also under the bare host, where no page has that URL before."""
    own = items.filter(F.trim(F.coalesce("url", F.lit(""))) != "").select("site_id", urls.normalize_url(F.col("url"), drop_query).alias("page"), "ord").filter("page is not null")
    www = r"(?i)^([a-z][a-z0-9+.-]*://)www[.]"
    names = F.expr(f"if(page rlike '{www}', array(named_struct('url', page, 'kind', 0), named_struct('url', regexp_replace(page, '{www}', '$1'), 'kind', 1)), array(named_struct('url', page, 'kind', 0)))")
    each = own.withColumn("n", F.explode(names)).select("site_id", "page", "ord", "n.url", "n.kind")
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("site_id", F.lower("url")).orderBy("ord", "kind"))).filter("_n = 1")
    return first.select("site_id", "url", F.concat(F.lit("pages/"), urls.page_file_key(F.col("page")), F.lit(".htm")).alias("file"))


def seed_subtrees(seeds: DataFrame, items: DataFrame) -> DataFrame:
    """site_id, seed, url, parent_url, level: each seed (site_id, url) with the pages below it, each page once, at the first level that has it.

    Cycles end at a page that is there already. One join a level for all sites and seeds, until a level is empty.
    """
    key = lambda c: urls.canonical_key(F.col(c))
    edges = cut(items.select("site_id", key("parent_url").alias("_p"), key("url").alias("_k"), "url", "parent_url", F.col("ord").alias("_o")).filter("_k <> '' and _k <> _p"))
    level = cut(seeds.select("site_id", F.col("url").alias("seed"), key("url").alias("_k"), "url", F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("level")).dropDuplicates(["site_id", "_k"]))
    found, depth = level, 0
    while True:
        depth += 1
        met = level.select("site_id", "seed", F.col("_k").alias("_p")).join(edges, ["site_id", "_p"])
        first = met.groupBy("site_id", "seed", "_k").agg(F.min_by(F.struct("url", "parent_url"), F.struct("_o", "parent_url")).alias("r")).select("site_id", "seed", "_k", "r.url", "r.parent_url", F.lit(depth).alias("level"))
        level = cut(first.join(found.select("site_id", "seed", "_k"), ["site_id", "seed", "_k"], "left_anti"))
        if level.head() is None:
            return found.drop("_k")
        found = cut(found.unionByName(level)) if depth % 16 == 0 else found.unionByName(level)


def run_status(sites: DataFrame) -> DataFrame:
    """site_id, status, pages_done of sites (site_id, pages_done, cap_reached, error): CAP where the store was full, ERROR where anything failed, else OK."""
    status = F.when(F.coalesce("cap_reached", F.lit(False)), "CAP").when(F.trim(F.coalesce("error", F.lit(""))) != "", "ERROR").otherwise("OK")
    return sites.select("site_id", status.alias("status"), F.coalesce("pages_done", F.lit(0)).alias("pages_done"))


def status_counts(statuses: DataFrame) -> DataFrame:
    """status, n_sites, pages_done."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("pages_done").alias("pages_done"))
