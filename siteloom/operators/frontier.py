"""Traversal of a link table as a crawl: level by level, with budgets, for all sites at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators.lineage import cut


def should_attach(parent: Column, child: Column, start: Column, protected: Column, structural: Column) -> Column:
    """Whether a link makes its target a child of its page: never itself, protected pages under the start page only, structural links always, others by path."""
    same = lambda a, b: F.lower(a) == F.lower(b)
    filled = (F.trim(F.coalesce(parent, F.lit(""))) != "") & (F.trim(F.coalesce(child, F.lit(""))) != "")
    return filled & ~same(parent, child) & ~(protected & ~same(parent, start)) & (structural | same(parent, start) | urls.is_url_descendant(parent, child))


def is_structural_child(parent: Column, child: Column, start: Column, parent_structural: Column, structural: Column, protected: Column) -> Column:
    return protected | structural | (parent_structural & (F.lower(parent) != F.lower(start)) & urls.is_url_descendant(parent, child))


def resolve_parent(parent: Column, child: Column, start: Column, parent_structural: Column, child_structural: Column, protected: Column) -> Column:
    return (
        F.when(protected | (F.trim(F.coalesce(parent, F.lit(""))) == "") | (F.lower(parent) == F.lower(start)), start)
        .when(child_structural, parent).when(~parent_structural & urls.is_url_descendant(parent, child), parent).otherwise(start)
    )


def should_upgrade(current: Column, new: Column, current_structural: Column, new_structural: Column, start: Column) -> Column:
    """Whether another parent is better: structural beats not, any page beats the root, the less deep of two on one path beats the deeper."""
    cur, low = F.lower(F.coalesce(current, F.lit(""))), F.lower(F.coalesce(new, F.lit("")))
    return (
        F.when((low == "") | (cur == low), False).when(new_structural & ~current_structural, True).when((cur == "") | (cur == F.lower(start)), low != F.lower(start))
        .when(urls.is_url_descendant(current, new), False).otherwise(urls.is_url_descendant(new, current))
    )


def seeds(sources: list[DataFrame]) -> DataFrame:
    """Union of seed tables (site_id, url, ord) in order of precedence: each URL once, from the first source that has it."""
    df = None
    for rank, s in enumerate(sources):
        own = s.select("site_id", "url", "ord").withColumn("source", F.lit(rank))
        df = own if df is None else df.unionByName(own)
    w = Window.partitionBy("site_id", F.lower("url")).orderBy("source", "ord")
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def link_budget(total: Column, used: Column) -> Column:
    """Exploratory links of a page: a sixth of all, four at least, no more than are left."""
    return F.greatest(F.lit(0), F.least(F.greatest(F.lit(4), F.floor(total / 6)), total - used))


def crawl(starts: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int = 1500, pages_per_depth: int = 0, links_per_page: int = 0) -> DataFrame:
    """site_id, url, depth, parent_url, ord of the pages that a breadth-first crawl visits, in its order.

    starts: site_id, url. links: site_id, url (the page), target, pos. A page is visited at the first level that links to it,
    from the first page, then place, that does. Budgets: levels, pages of a site, pages of a level, links of a page (0: no
    limit). One join per level for all sites; a level's order comes from its parents' order, so nothing is ordered globally.
    """
    own = links.select("site_id", F.lower("url").alias("_page"), "target", "pos")
    if links_per_page > 0:
        own = own.withColumn("_k", F.row_number().over(Window.partitionBy("site_id", "_page").orderBy("pos"))).filter(F.col("_k") <= links_per_page).drop("_k")
    own = cut(own)
    level = starts.select("site_id", "url", F.lit("").alias("parent_url"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord")).dropDuplicates(["site_id"])
    level = cut(level)
    visited = level
    for d in range(1, max_depth + 1):
        met = level.select("site_id", F.lower("url").alias("_page"), F.col("url").alias("_from"), F.col("ord").alias("_ord")).join(own, ["site_id", "_page"])
        first = met.groupBy("site_id", F.lower("target").alias("_key")).agg(F.min(F.struct("_ord", "pos", "target", "_from")).alias("f"))
        new = first.join(visited.select("site_id", F.lower("url").alias("_key")), ["site_id", "_key"], "left_anti")
        count = visited.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n"))
        rank = F.row_number().over(Window.partitionBy("site_id").orderBy("f._ord", "f.pos", "f.target")).cast("long")
        new = new.withColumn("_k", rank).join(count, "site_id").filter(F.col("_k") + F.col("_n") <= max_pages)
        if pages_per_depth > 0:
            new = new.filter(F.col("_k") <= pages_per_depth)
        level = cut(new.select("site_id", F.col("f.target").alias("url"), F.col("f._from").alias("parent_url"), F.lit(d).alias("depth"), (F.col("_n") + F.col("_k") - 1).alias("ord")))
        if level.head() is None:
            break
        visited = visited.unionByName(level)
    return visited
