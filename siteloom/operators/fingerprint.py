"""Template fingerprints: what a page shares with others of its kind, and a short hash of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text, urls, vocab
from siteloom.operators import classify, navigation


def telling_classes(classes: Column) -> Column:
    """Of a body's classes those that tell the template: each once, in order, six at most."""
    low = F.transform(classes, lambda c: F.lower(c))

    def tells(c: Column) -> Column:
        out = text.contains_any(c, vocab.CLASS_PARTS)
        for s in vocab.CLASS_STARTS:
            out = out | c.startswith(s)
        return out

    return F.slice(F.array_sort(F.array_distinct(F.filter(low, tells))), 1, 6)


def section_bucket(n: Column) -> Column:
    return F.when(n == 0, "none").when(n <= 3, "small").when(n <= 8, "medium").otherwise("large")


def fingerprint_hash(parts: dict[str, Column]) -> Column:
    """First 16 hex digits of the SHA-256 of key=value pairs, keys in order."""
    pairs = [F.concat(F.lit(f"{k}="), v) for k, v in sorted(parts.items(), key=lambda kv: kv[0].lower())]
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *pairs), 256), 1, 16))


def fingerprints(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with path_shape, cms, classes, content_type, heading_shape, section_bucket, four flags and fingerprint; a page's elements are read once."""
    df = pages.withColumn("_s", navigation.template_signs(F.col(html_col)))
    sign = lambda k: F.col(f"_s.{k}") > 0
    signs = {k: sign(k) for k in classify.SIGNS} | {"list_items": F.col("_s.list_items") > 5}
    df = df.withColumn("_type", classify.content_type(urls.path(F.col(url_col)), F.col("_s.heading"), signs)).withColumn("cms", classify.detect_cms(F.col(html_col))["kind"])
    df = (
        df.withColumn("path_shape", urls.path_shape(F.col(url_col)))
        .withColumn("content_type", F.col("_type.content_type"))
        .withColumn("classes", telling_classes(F.col("_s.body_classes")))
        .withColumn("heading_shape", F.concat(*(x for k in ("h1", "h2", "h3") for x in (F.lit(("" if k == "h1" else ",") + k + ":"), F.col(f"_s.{k}").cast("string")))))
        .withColumn("section_bucket", section_bucket(F.col("_s.sections")))
        .withColumns({k: sign(k) for k in ("has_main", "has_breadcrumb", "has_local_nav", "has_header_nav")})
        .drop("_type", "_s")
    )
    flag = lambda c: F.when(F.col(c), "1").otherwise("0")
    parts = {
        "classes": F.array_join("classes", ","), "cms": F.col("cms"), "contentType": F.col("content_type"), "hasBreadcrumb": flag("has_breadcrumb"), "hasHeaderNav": flag("has_header_nav"),
        "hasLocalNav": flag("has_local_nav"), "hasMain": flag("has_main"), "headingShape": F.col("heading_shape"), "pathShape": F.col("path_shape"), "sectionBucket": F.col("section_bucket"),
    }
    return df.withColumn("fingerprint", fingerprint_hash(parts))
