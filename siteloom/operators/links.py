"""Links of pages: extraction, classification with a reason for each rejection, histograms, caps and spread samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text, urls

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
REASONS = ("empty_href", "hash_link", "javascript_link", "mailto", "tel", "invalid_url", "external_host", "binary_asset", "noise_path", "duplicate")


def anchors(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, page_url, pos (from 0), href, text of each anchor, in document order. Expressions only: no Python sees the page."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(ANCHOR), 0)  # the page is searched once, its parts in the short matches
    each = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("page_url"), F.posexplode(found).alias("pos", "a"))
    clean = text.collapse_whitespace(text.html_unescape(F.regexp_replace(F.regexp_extract("a", ANCHOR, 2), "(?s)<[^>]*>", "")))
    return each.select("page_id", "page_url", "pos", text.html_unescape(F.regexp_extract("a", ANCHOR, 1)).alias("href"), clean.alias("text"))


def classified(links: DataFrame, drop_query: bool = True) -> DataFrame:
    """links (page_id, page_url, pos, href, ...) with url and reason: the first rule that rejects a link, null if none.

    A URL that the same page has linked before is a duplicate; the first one in document order counts.
    """
    h = F.trim(F.coalesce(F.col("href"), F.lit("")))
    low = F.lower(h)
    absolute = urls.absolutize(F.col("page_url"), F.col("href"))
    df = links.withColumn("url", urls.normalize_url(absolute, drop_query))
    u = F.col("url")
    first_rule = (
        F.when(h == "", "empty_href")
        .when(h.startswith("#"), "hash_link")
        .when(low.startswith("javascript:"), "javascript_link")
        .when(low.startswith("mailto:"), "mailto")
        .when(low.startswith("tel:"), "tel")
        .when(absolute.isNull() | ~urls.is_http_url(u) | ~urls.is_absolute(u), "invalid_url")
        .when(~urls.same_site_host(urls.host(u), urls.host(F.col("page_url"))), "external_host")
        .when(urls.is_binary_asset(urls.path(u)), "binary_asset")
        .when(urls.is_noise_path(urls.normalize_path(urls.path(u))), "noise_path")
    )
    df = df.withColumn("reason", first_rule)
    seen = Window.partitionBy("page_id", F.lower("url"), F.col("reason").isNull()).orderBy("pos")
    return df.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(seen) > 1), "duplicate").otherwise(F.col("reason"))).withColumn("url", F.when(F.col("reason").isNull() | (F.col("reason") == "duplicate"), u))


def reject_histogram(classified_links: DataFrame) -> DataFrame:
    return classified_links.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def internal(classified_links: DataFrame) -> DataFrame:
    """Accepted links, rewritten to the host of their page."""
    page_host = urls.host(F.col("page_url"))
    u = F.col("url")
    return classified_links.filter("reason is null").withColumn("url", F.when(urls.host(u) != page_host, F.concat(urls.scheme(u), F.lit("://"), page_host, urls.port(u), F.regexp_extract(u, r"^[^/]*//[^/?#]*(.*)$", 1))).otherwise(u))


def best_by_confidence(links: DataFrame) -> DataFrame:
    """One row per page and URL: the link of the highest confidence, the first of those that tie."""
    own = Window.partitionBy("page_id", F.lower("url")).orderBy(F.desc("confidence"), "pos")
    return links.withColumn("_rank", F.row_number().over(own)).filter("_rank = 1").drop("_rank")


def first_tier(links: DataFrame) -> DataFrame:
    """One row per page and URL: that of the first tier, then of the first place."""
    own = Window.partitionBy("page_id", F.lower("url")).orderBy("tier", "pos")
    return links.withColumn("_rank", F.row_number().over(own)).filter("_rank = 1").drop("_rank")


def capped(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each key in the given order."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(own)).filter(F.col("_rank") <= most).drop("_rank")


def spread_sample(rows: DataFrame, keys: list[str], order: list, take: int, url_col: str = "url") -> DataFrame:
    """`take` rows of each key, spread evenly from the first to the last (places rounded half to even), each URL once.

    Keys with no more rows than that keep all; take <= 0 keeps all, 1 keeps the first.
    """
    if take <= 0:
        return rows
    own = Window.partitionBy(*keys)
    df = rows.withColumn("_i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    places = F.when(F.lit(take == 1), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(take - 1)), lambda i: F.bround(i * ((F.col("_n") - 1).cast("double") / F.lit(float(max(take - 1, 1)))), 0).cast("int")))
    df = df.filter((F.col("_n") <= take) | F.array_contains(places, F.col("_i")))
    once = Window.partitionBy(*keys, F.lower(url_col), F.col("_n") > take).orderBy("_i")
    return df.withColumn("_k", F.row_number().over(once)).filter((F.col("_n") <= take) | (F.col("_k") == 1)).drop("_i", "_n", "_k")
