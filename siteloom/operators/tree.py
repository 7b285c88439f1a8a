"""Trees from parent pointers: closure over paths, preorder, neighbours in reading order, node counts, search."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.operators.lineage import EVERY, cut


def edges(items: DataFrame) -> DataFrame:
    """site_id, child, parent, ord: one row for each known parent of a page, without edges to itself. Pages may have several rows, and parents."""
    key = items.select("site_id", F.lower("url").alias("child"), F.lower(F.coalesce("parent_url", F.lit(""))).alias("parent"), "ord")
    known = key.select("site_id", F.col("child").alias("parent")).distinct()
    return key.filter("child <> '' and child <> parent").join(known, ["site_id", "parent"], "left_semi").groupBy("site_id", "child", "parent").agg(F.min("ord").alias("ord"))


def nodes(items: DataFrame) -> DataFrame:
    """site_id, node, url, title (the first that isn't blank), ord, start."""
    own = items.withColumn("node", F.lower("url")).filter("node <> ''")
    blank = F.trim(F.coalesce("title", F.lit(""))) == ""
    return own.groupBy("site_id", "node").agg(
        F.min_by("url", "ord").alias("url"), F.coalesce(F.min_by(F.when(~blank, F.col("title")), F.when(~blank, F.col("ord"))), F.lit("")).alias("title"), F.min("ord").alias("ord"), F.max(F.lower("start_url")).alias("start")
    )


def paths(items: DataFrame) -> DataFrame:
    """site_id, node, path (nodes from the root), order (sibling places), level: one row for each way from a root to a node.

    Roots are the start page, first, and pages without a known parent. A page with several parents has a row for each way;
    a way never comes back to a node that it has passed.
    """
    items = cut(items)
    e, n = cut(edges(items)), cut(nodes(items))
    roots = n.join(e.select("site_id", F.col("child").alias("node")).distinct(), ["site_id", "node"], "left_anti").unionByName(n.filter("node = start")).distinct()
    place = F.when(F.col("node") == F.col("start"), F.lit(-1).cast("long")).otherwise(F.col("ord").cast("long"))
    level = cut(roots.select("site_id", "node", F.array("node").alias("path"), F.array(place).alias("order"), F.lit(0).alias("level")))
    out = level
    down = e.select("site_id", F.col("parent").alias("node"), "child", "ord")
    start = n.filter("node = start").select("site_id", F.col("node").alias("child"))
    down = down.join(start, ["site_id", "child"], "left_anti")
    for k in count(1):
        level = level.join(down, ["site_id", "node"]).filter(~F.array_contains("path", F.col("child")))
        level = level.select("site_id", F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"), F.concat("order", F.array(F.col("ord").cast("long"))).alias("order"), F.lit(k).alias("level"))
        level = cut(level)
        if level.head() is None:
            break
        out = out.unionByName(level)
        if k % EVERY == 0:
            out = cut(out)
    return out


def node_counts(items: DataFrame) -> DataFrame:
    """Nodes of each site's tree; a page with several parents counts once for each way to it."""
    return paths(items).groupBy("site_id").agg(F.count(F.lit(1)).alias("tree_nodes"), F.max("level").alias("max_level"))


def preorder(items: DataFrame) -> DataFrame:
    """site_id, pos (from 0), url, title, level in depth-first order, and the pages before and after."""
    own = Window.partitionBy("site_id").orderBy("order")
    items = cut(items)
    df = paths(items).withColumn("pos", F.row_number().over(own) - 1).join(nodes(items).select("site_id", "node", "url", "title"), ["site_id", "node"])
    around = Window.partitionBy("site_id").orderBy("pos")
    return df.select("site_id", "pos", "url", "title", "level", F.lag("url").over(around).alias("prev_url"), F.lead("url").over(around).alias("next_url"))


def descendants(items: DataFrame) -> DataFrame:
    """site_id, ancestor, node for all pairs, a node included as its own ancestor."""
    return paths(items).select("site_id", "node", F.explode("path").alias("ancestor")).distinct()


def search(items: DataFrame, text: str) -> DataFrame:
    """Pages that a search of the tree shows: title or URL contains the text, or a descendant's does."""
    low = text.lower()
    hit = nodes(items).filter(F.lower("title").contains(low) | F.col("node").contains(low)).select("site_id", "node")
    shown = descendants(items).join(hit, ["site_id", "node"], "left_semi").select("site_id", F.col("ancestor").alias("node")).distinct()
    return nodes(items).join(shown, ["site_id", "node"], "left_semi")


def by_depth(items: DataFrame) -> DataFrame:
    """items with parent_url where none has one: the last earlier row of the site that is less deep."""
    a = items.select("site_id", "ord", "url", "depth")
    prior = a.select("site_id", F.col("ord").alias("_o"), F.col("url").alias("_u"), F.col("depth").alias("_d"))
    # the nearest earlier row of each smaller depth is a running maximum per depth, so no row meets all earlier ones
    depths = a.select("site_id", F.col("depth").alias("_d")).distinct()
    grid = a.join(depths, "site_id").filter("_d < depth").select("site_id", "ord", "_d")
    events = grid.select("site_id", "_d", "ord", F.lit(None).cast("string").alias("_u")).unionByName(prior.select("site_id", "_d", F.col("_o").alias("ord"), "_u"))
    run = Window.partitionBy("site_id", "_d").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("_last", F.last(F.when(F.col("_u").isNotNull(), F.struct("ord", "_u")), ignorenulls=True).over(run)).filter("_u is null and _last is not null")
    parent = seen.groupBy("site_id", "ord").agg(F.max("_last").alias("p")).select("site_id", "ord", F.col("p._u").alias("_parent"))
    return items.join(parent, ["site_id", "ord"], "left").withColumn("parent_url", F.coalesce("_parent", F.lit(""))).drop("_parent")
