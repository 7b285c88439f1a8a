"""Readers: URL lists, sitemaps, JSON documents, event logs, run folders, REST page lists. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.functions import urls

NAV_ITEM = "url string, title string, depth int, parentUrl string, isExternal boolean, isJsDynamic boolean, isDisplayOnly boolean, isSynthetic boolean, isUtility boolean, municipalRootClassification string"
NAV_DOCUMENT = f"""host string, startUrl string, cmsKind string, generatedUtc string, flat array<struct<{NAV_ITEM.replace(' ', ':').replace(',:', ', ')}>>"""
EVENT = "timestampUtc string, runId string, targetId string, municipality string, host string, phase string, eventName string, severity string, url string, fields map<string,string>"


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url of each line that isn't blank or a comment, with a scheme, each once without regard to case, in the order of the lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("ord"))
    return distinct_urls(lines.filter("line <> '' and not line like '#%'"))


def url_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """The same for lines in memory."""
    df = spark.createDataFrame([(i, x.strip()) for i, x in enumerate(lines)], "ord long, line string")
    return distinct_urls(df.filter("line <> '' and not line like '#%'"))


def distinct_urls(lines: DataFrame) -> DataFrame:
    df = lines.withColumn("url", urls.ensure_scheme(F.col("line")))
    return df.groupBy(F.lower("url").alias("_k")).agg(F.min_by("url", "ord").alias("url"), F.min("ord").alias("ord")).select("ord", "url")


def sitemap_locations(documents: DataFrame, xml_col: str = "xml") -> DataFrame:
    """documents with kind (index or urlset) and loc, one row per location. Namespaces don't matter; XML that doesn't parse has none."""
    clean = F.regexp_replace(F.col(xml_col), r"(?s)<\?xml.*?\?>", "")
    locs = F.regexp_extract_all(clean, F.lit(r"(?is)<(?:\w+:)?loc[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"), 1)
    kind = F.when(clean.rlike(r"(?i)<(\w+:)?sitemapindex[\s>]"), "index").otherwise("urlset")
    return documents.withColumn("kind", kind).withColumn("loc", F.explode(locs))


def robots_sitemaps(robots: DataFrame, text_col: str = "text") -> DataFrame:
    """robots with sitemap, one row per `Sitemap:` line."""
    return robots.withColumn("sitemap", F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)))


#: Where a site's map is looked for if its robots file names none.
WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml")


def sitemap_roots(sites: DataFrame, robots: DataFrame, documents: DataFrame) -> DataFrame:
    """site_id, url of the maps to start from: those that robots (site_id, text) name, else the first well-known place that documents (url) have.

    sites: site_id, start_url.
    """
    named = robots_sitemaps(robots).select("site_id", F.col("sitemap").alias("url")).distinct()
    origin = F.regexp_extract("start_url", r"^([a-z][a-z0-9+.-]*://[^/?#]+)", 1)
    guessed = sites.join(named.select("site_id").distinct(), "site_id", "left_anti").select("site_id", F.posexplode(F.array(*(F.concat(origin, F.lit(w)) for w in WELL_KNOWN))).alias("rank", "url"))
    there = guessed.withColumn("_k", F.lower("url")).join(documents.select(F.lower("url").alias("_k")).distinct(), "_k", "left_semi")
    return named.unionByName(there.groupBy("site_id").agg(F.min_by("url", "rank").alias("url")))


def sitemap_urls(documents: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """site_id, url of all pages that the root sitemaps lead to. documents: url, xml of fetched sitemaps; roots: site_id, url. Indexes are followed to a depth of three."""
    docs = sitemap_locations(documents).select(F.lower("url").alias("_key"), "kind", "loc")
    level, out = roots.select("site_id", F.lower("url").alias("_key")), None
    for _ in range(max_depth + 1):
        met = level.join(docs, "_key")
        pages = met.filter("kind = 'urlset'").select("site_id", F.col("loc").alias("url"))
        out = pages if out is None else out.unionByName(pages)
        level = met.filter("kind = 'index'").select("site_id", F.lower("loc").alias("_key")).distinct()
    return out.groupBy("site_id", F.lower("url").alias("_k")).agg(F.min("url").alias("url")).select("site_id", "url")


def rest_pages(documents: DataFrame, json_col: str = "json", most: int = 100) -> DataFrame:
    """documents with url, title, menu_order, confidence: menu items (.99) of a REST answer, else its first published pages (.95), in menu order."""
    menu = F.from_json(json_col, "items array<struct<url:string,title:string,menu_order:int>>")["items"]
    page = F.from_json(json_col, "array<struct<link:string,title:struct<rendered:string>,menu_order:int,status:string>>")
    pages = F.slice(F.filter(F.transform(page, lambda p: F.struct(p["link"].alias("url"), p["title"]["rendered"].alias("title"), p["menu_order"].alias("menu_order"), p["status"].alias("status"))), lambda p: F.coalesce(p["status"], F.lit("publish")) == "publish"), 1, most)
    rows = F.when(F.size(F.coalesce(menu, F.array())) > 0, F.transform(menu, lambda p: F.struct(p["url"].alias("url"), p["title"].alias("title"), p["menu_order"].alias("menu_order"), F.lit(0.99).alias("confidence")))).otherwise(
        F.transform(pages, lambda p: F.struct(p["url"].alias("url"), p["title"].alias("title"), p["menu_order"].alias("menu_order"), F.lit(0.95).alias("confidence")))
    )
    return documents.withColumn("_p", F.explode(rows)).select("*", "_p.*").drop("_p").filter("url is not null")


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON documents with their path; names match without regard to case, fields that are absent are null, broken files have nulls alone."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.withColumn("source_path", F.col("_metadata.file_path"))


def nav_items(documents: DataFrame) -> DataFrame:
    """site_id, ord, url, title, parent_url, depth, start_url and flags from navigation documents: absent is empty, false or 0."""
    df = documents.select(F.lower("host").alias("site_id"), F.col("startUrl").alias("start_url"), F.posexplode("flat").alias("ord", "i"))
    flag = lambda c: F.coalesce(F.col(f"i.{c}"), F.lit(False))
    word = lambda c: F.coalesce(F.col(f"i.{c}"), F.lit(""))
    return df.select(
        "site_id", F.col("ord").cast("long").alias("ord"), word("url").alias("url"), word("title").alias("title"), word("parentUrl").alias("parent_url"), F.coalesce("i.depth", F.lit(0)).alias("depth"), "start_url",
        flag("isExternal").alias("is_external"), flag("isJsDynamic").alias("is_js_dynamic"), flag("isDisplayOnly").alias("is_display_only"), flag("isSynthetic").alias("is_synthetic"), flag("isUtility").alias("is_utility"), word("municipalRootClassification").alias("root_class"),
    )


def event_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Events of JSON lines; blank and unreadable lines are left out. fields stays a map of strings, read as typed by field()."""
    parsed = F.from_json(F.col(col), EVENT, {"mode": "PERMISSIVE"})
    return lines.withColumn("_e", parsed).filter(F.col("_e.eventName").isNotNull()).select(*[c for c in lines.columns if c != col], "_e.*")


def field(name: str, kind: str = "string"):
    return F.try_element_at("fields", F.lit(name)).cast("string") if kind == "string" else F.expr(f"try_cast(try_element_at(fields, '{name}') as {kind})")


def run_folders(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifests found by a path pattern, with folder: the name of the folder that each lies in. Broken ones are left out."""
    df = json_documents(spark, path, schema)
    first = df.columns[0]
    return df.filter(F.col(first).isNotNull()).withColumn("folder", F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1))


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


PROFILES = (
    ("smoke", 0, 1, 0, 0, 10), ("cms-diagnostic", 1, 50, 15, 50, 20), ("nav-diagnostic", 3, 200, 20, 70, 50), ("snapshot-diagnostic", 2, 40, 10, 30, 20), ("full-validation", 3, 1500, 0, 0, 100),
)


def profiles(spark: SparkSession) -> DataFrame:
    """Built-in budgets: name, max_depth, max_pages, children_per_page, pages_per_depth, saturation_window."""
    return spark.createDataFrame(PROFILES, "name string, max_depth int, max_pages int, children_per_page int, pages_per_depth int, saturation_window int")


def with_profile(runs: DataFrame, table: DataFrame, default: str = "smoke") -> DataFrame:
    """runs (profile) with the budgets of their profile, or of the default one where there is none of that name."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    own = table.withColumn("_k", F.lower("name"))
    known = own.select("_k").distinct().withColumn("_known", F.lit(True))
    df = runs.withColumn("_k", low("profile")).join(F.broadcast(known), "_k", "left")  # a handful of profiles
    df = df.withColumn("_k", F.when(F.col("_known"), F.col("_k")).otherwise(F.lit(default))).drop("_known")
    return df.join(F.broadcast(own), "_k", "left").drop("_k")
