"""Links of pages by the place they stand in: header navigation, structural links, local tiers, listings, theme menus, groups.

`placed_links` reads each page once and says for each link which places it stands in; all else is columns over that. What only
a browser knows (visible, top, left of a link) may be columns of the input, by default visible and without a place on screen.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text, urls
from siteloom.operators import css

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

# Places of links as selectors that hold for a link or anything around it.
PLACES = {
    "header": "header",
    "nav": "nav",
    "role_nav": "[role=navigation]",
    "menu_class": ".menu, .nav, .navbar, .main-nav, .top-nav, .site-nav",
    "header_root": "header, .main-nav, .top-nav, .site-nav, .navbar, .menu, nav[aria-label], [role=navigation]",
    "tools": ".sol-tool-nav, .tools, .utility, .service-nav",
    "service": ".sol-tool-nav, .utility, .service-nav, footer",
    "footer": "footer",
    "crumb_class": ".breadcrumb, .breadcrumbs",
    "breadcrumb": '.breadcrumb, .breadcrumbs, nav[aria-label*="breadcrumb" i], [aria-label*="breadcrumb" i]',
    "listing": ".sol-page-listing",
    "aside": "aside, .sidebar, .sidenav",
    "header_nav": "header nav, header [role=navigation]",
    "any_nav": "nav, [role=navigation]",
}
# Containers of structural links, in the order in which they are looked for.
CONTAINERS_INNER = (".sol-page-listing", "aside", ".sidebar", ".sidenav", ".breadcrumb", ".breadcrumbs")
CONTAINERS = (*CONTAINERS_INNER, "nav", "[role=navigation]", ".menu", ".nav", ".navbar", "header")
# Menus of WordPress themes, from the most to the least specific, with their confidence.
WORDPRESS_MENUS = (
    (".wp-block-navigation a[href]", 0.97), ("nav.main-navigation a[href]", 0.96), ("nav#site-navigation a[href]", 0.96), ("#main-navigation a[href]", 0.95), (".primary-navigation a[href]", 0.95),
    ("#primary-menu a[href]", 0.94), (".nav-primary a[href]", 0.94), ("ul.menu a[href]", 0.90), (".menu-main-menu-container a[href]", 0.90), ("header nav a[href]", 0.87),
)
# Links that match by themselves.
SELVES = {
    "listing_item": "nav.sol-page-listing li.sol-page-listing-item > a[href], .sol-page-listing li.sol-page-listing-item > a[href], .sol-page-listing a.sol-page-listing-item__link[href]",
    "event_place": ".sol-event-item a[href], .eventslist a[href], [data-portlet-id] a[href], .sv-custom-module a[href]",
    "event_after": "#h-Evenemang ~ * a[href], a[href*='/arkiv/evenemang']",
    **{f"wp{i}": s for i, (s, _) in enumerate(WORDPRESS_MENUS)},
}
# What the text around a link of an event says, and the tiers of local links with their confidence.
EVENTISH = r"evenemang|aktivitet|bibliotek|\b\d{4}-\d{2}-\d{2}\b"
TIERS = (("page-listing", "listing", 0.95), ("nav", "any_nav", 0.90), ("aside", "aside", 0.85), ("breadcrumb", "breadcrumb", 0.93))

PLACED = "page_id long, page_url string, pos int, href string, text string, title string, label string, heading string, places array<string>, counts map<string,int>, eventish boolean"


def placed_links(pages: DataFrame, selves: dict[str, str] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each link: page_id, page_url, pos, href, text, title, label (aria-label), heading (the first in it), places, counts, eventish, visible, top, left.

    places: names of PLACES that hold for the link or an element around it, and of SELVES (and `selves`) that the link itself
    matches. counts: for each of CONTAINERS around it, the links in the nearest one. eventish: the text of the nearest block
    around it is about an event. Pages without markup, or null, have no links.
    """
    own_selves = SELVES | (selves or {})

    def rows(batches):
        import re

        import pyarrow as pa

        around = {k: css.compiled(s) for k, s in PLACES.items()}
        boxes = {s: css.compiled(s) for s in CONTAINERS}
        alone = {k: css.compiled(s) for k, s in own_selves.items()}
        block = css.compiled("[id], section, article, div")
        heading = frozenset("h1 h2 h3 h4 h5 h6".split())
        about = re.compile(EVENTISH)
        names = [c.split()[0] for c in PLACED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.map_(pa.string(), pa.int32()), pa.bool_()]
        fits = lambda page, k, selector: any(css._fits(page, k, steps, len(steps) - 1) for steps in selector)
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, url, html in zip(*(b.column(c).to_pylist() for c in range(3))):
                page = css.Page(html)
                anchors = [k for k, n in enumerate(page.nodes) if n.tag == "a" and "href" in n.attrs]
                seen: dict[int, tuple] = {}

                def place(k: int) -> tuple:
                    """Names that hold at an element or above, and the nearest element of each container."""
                    if k < 0:
                        return frozenset(), {}
                    if k not in seen:
                        names_, near = place(page.nodes[k].parent)
                        found = {s: k for s, c in boxes.items() if fits(page, k, c)}
                        seen[k] = names_ | {x for x, c in around.items() if x not in names_ and fits(page, k, c)}, (near | found if found else near)
                    return seen[k]

                inside: dict[int, int] = {}
                for a in anchors:
                    for k in page.above(a):
                        inside[k] = inside.get(k, 0) + 1
                blocks: dict[int, bool] = {}
                for pos, a in enumerate(anchors):
                    n = page.nodes[a]
                    held, near = place(a)
                    root = next((k for k in page.above(a) if fits(page, k, block)), None)
                    if root is not None and root not in blocks:
                        blocks[root] = bool(about.search(page.text(root).lower()))
                    head = next((page.text(k) for k in range(a + 1, len(page.nodes)) if page.nodes[k].tag in heading and a in page.above(k)), "") if any(x.tag in heading for x in page.nodes[a + 1 : a + 8]) else ""
                    selves_ = {x for x, c in alone.items() if fits(page, a, c)}
                    row = (i, url, pos, n.attrs["href"], page.text(a), " ".join(n.attrs.get("title", "").split()), " ".join(n.attrs.get("aria-label", "").split()), head, sorted(held | selves_), [(s, inside[k]) for s, k in sorted(near.items())], blocks.get(root, False))
                    for column, v in zip(out, row):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    found = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("page_url"), F.col(html_col).cast("string").alias("html")).mapInArrow(rows, PLACED)
    return with_layout(found)


def with_layout(found: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """found with visible, top, left of each link from a table (page_id, pos, visible, top, left); visible and no place where it has none."""
    if layout is None:
        return found.withColumn("visible", F.lit(True)).withColumn("top", F.lit(None).cast("double")).withColumn("left", F.lit(None).cast("double"))
    own = layout.select("page_id", "pos", F.col("visible").alias("_v"), F.col("top").cast("double").alias("_t"), F.col("left").cast("double").alias("_l"))
    return found.drop("visible", "top", "left").join(own, ["page_id", "pos"], "left").withColumn("visible", F.coalesce("_v", F.lit(True))).withColumnsRenamed({"_t": "top", "_l": "left"}).drop("_v")


def within(place: str) -> Column:
    return F.array_contains("places", place)


def label_of() -> Column:
    """What a link is called: its text, title, aria-label or address, the first that isn't empty."""
    first = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    return F.coalesce(first("text"), first("title"), first("label"), first("href"))


def usable(found: DataFrame) -> DataFrame:
    """Links that lead to a page: with `url` (absolute) and `name`; no fragments, scripts, mail or telephone links."""
    low = F.lower(F.trim("href"))
    kept = found.filter((low != "") & ~low.rlike("^(#|javascript:|mailto:|tel:)"))
    return kept.withColumn("url", urls.absolutize(F.col("page_url"), F.col("href"))).withColumn("name", label_of()).filter("url is not null")


def best(rows: DataFrame, *first: Column) -> DataFrame:
    """One row per page and URL: the first by the given order, then by place."""
    w = Window.partitionBy("page_id", "url").orderBy(*first, "pos")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def _if(condition: Column, value: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)


def _between(low: float, c: Column, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def header_links(found: DataFrame) -> DataFrame:
    """page_id, url, name, pos, confidence of visible links of the header navigation: each URL once, by its highest confidence."""
    top, left, n = F.col("top"), F.col("left"), F.length("name")
    place = F.when((top >= 0) & (top < 260), 0.10).when(top < 500, 0.04).otherwise(0.0) + _if((left >= 0) & (left < 1600), 0.03)
    around = _if(within("header"), 0.08) + _if(within("nav"), 0.06) + _if(within("role_nav"), 0.06) + _if(within("menu_class"), 0.06) - _if(within("tools"), 0.18) - _if(within("footer"), 0.30) - _if(within("crumb_class"), 0.20)
    own = _if(n >= 4, 0.03) + _if(n >= 9, 0.03) - _if(n > 45, 0.05)
    scored = usable(found).filter(F.col("visible") & within("header_root")).withColumn("confidence", _between(0.05, F.lit(0.80) + place + around + own, 0.999))
    return best(scored, F.desc("confidence")).select("page_id", "url", "name", "pos", "confidence")


def structural_links(found: DataFrame, is_start: Column) -> DataFrame:
    """page_id, url, name, pos, kind, confidence of visible links that show a site's structure: each URL once, by its highest confidence.

    is_start: whether the page is its site's start page; there, links of any navigation count, elsewhere breadcrumbs, page
    listings and side columns only. Addresses that are noise are left out.
    """
    start = F.coalesce(is_start, F.lit(False))
    counts = lambda names: F.coalesce(*(F.element_at("counts", F.lit(s)) for s in names), F.lit(0))
    n_links = F.when(start, counts(CONTAINERS)).otherwise(counts(CONTAINERS_INNER))
    rules = (
        (within("breadcrumb"), "breadcrumb", 0.96), (within("listing"), "page-listing", 0.95), (within("aside"), "aside", 0.87), (start & within("header_nav"), "header-nav", 0.93),
        (start & within("any_nav"), "nav", 0.91), (start & (n_links >= 4), "grouped", 0.70), (start, "structural", 0.55),
    )
    kind, base = F.lit(None).cast("string"), F.lit(None).cast("double")
    for rule, name, value in reversed(rules):
        kind, base = F.when(rule, name).otherwise(kind), F.when(rule, value).otherwise(base)
    top, left, n = F.col("top"), F.col("left"), F.length("name")
    place = F.when((top >= 0) & (top < 320), 0.06).when(top < 700, 0.04).when(top > 1600, -0.04).otherwise(0.0) + _if((left >= 0) & (left < 500), 0.02)
    # a crowd counts only where the link has a container, which a start page's plain link has not
    score = F.col("base") + 0.04 + _if(n >= 6, 0.02) + _if(n >= 14, 0.02) + place + _if(F.col("n_links") >= 4, 0.04) + _if(F.col("n_links") >= 8, 0.04) - _if(within("service"), 0.18)
    df = usable(found).filter("visible").filter(~urls.is_noise_path(urls.path(F.col("url")))).withColumn("n_links", n_links).withColumn("kind", kind).withColumn("base", base).filter("kind is not null")
    return best(df.withColumn("confidence", _between(0.01, score, 0.999)), F.desc("confidence")).select("page_id", "url", "name", "pos", "kind", "confidence")


def local_links(found: DataFrame, most: int = 80) -> DataFrame:
    """page_id, url, name, pos, kind, confidence, is_structural, rank of a page's own navigation, `most` links at most.

    Tiers: page listing, navigation, side column, breadcrumb; a URL belongs to the first that has it. A page without any has
    its visible links instead, at 0.10. Links of other sites are left out.
    """
    own = usable(found).filter(urls.same_site_host(urls.host(F.col("url")), urls.host(F.col("page_url"))))
    tier = F.lit(len(TIERS))
    for k in reversed(range(len(TIERS))):
        tier = F.when(within(TIERS[k][1]), k).otherwise(tier)
    named = F.coalesce(F.when(within("listing") & (F.col("heading") != ""), F.col("heading")), F.when(F.col("text") != "", F.col("text")), F.when(F.col("title") != "", F.col("title")), F.col("url"))
    df = own.withColumn("tier", tier).withColumn("name", named)
    page = Window.partitionBy("page_id")
    df = df.withColumn("_least", F.min("tier").over(page)).filter((F.col("tier") < len(TIERS)) | ((F.col("_least") == len(TIERS)) & F.col("visible")))
    df = best(df, F.col("tier")).withColumn("rank", F.row_number().over(page.orderBy("tier", "pos"))).filter(F.col("rank") <= max(1, most or 80))
    pick = lambda values, last: F.coalesce(F.get(F.array(*(F.lit(v) for v in values)), F.col("tier")), F.lit(last))
    return df.select("page_id", "url", "name", "pos", pick([t[0] for t in TIERS], "content").alias("kind"), pick([t[2] for t in TIERS], 0.10).alias("confidence"), (F.col("tier") < len(TIERS)).alias("is_structural"), "rank")


def page_listing(found: DataFrame) -> DataFrame:
    """page_id, url, name, pos, confidence of the links of a page listing, called by the heading in them; the first of each URL."""
    own = usable(found).filter(within("listing_item")).withColumn("name", F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("text")))
    return best(own).select("page_id", "url", "name", "pos", F.lit(0.95).alias("confidence"))


def theme_menu(found: DataFrame) -> DataFrame:
    """page_id, url, name, pos, confidence of a WordPress theme's menu.

    The menus are looked at from the most specific one on, up to the first with three visible links or more; a URL has the
    confidence of the best menu that it is in.
    """
    menus = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(f"wp{i}").alias("name"), F.lit(score).alias("confidence")) for i, (_, score) in enumerate(WORDPRESS_MENUS)))
    own = usable(found).filter("visible").withColumn("m", F.explode(F.filter(menus, lambda m: F.array_contains(F.col("places"), m["name"])))).select("*", "m.rank", "m.confidence")
    enough = own.groupBy("page_id", "rank").agg(F.count(F.lit(1)).alias("n")).groupBy("page_id").agg(F.min(F.when(F.col("n") >= 3, F.col("rank"))).alias("last"))
    kept = own.join(enough, "page_id").filter("last is null or rank <= last")
    return best(kept, F.desc("confidence")).select("page_id", "url", "name", "pos", "confidence")


def tree_menu(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, name, pos, confidence of the items (uri, displayName) that scripts of a page hand to its tree menu; the first of each URL."""
    script = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1)
    each = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("page_url"), F.posexplode(F.filter(script, lambda s: s.contains("TreeMenu"))).alias("_s", "script"))
    items = F.from_json(text.json_array_after(F.col("script"), '"items"'), "array<struct<uri:string,displayName:string>>")
    found = each.select("page_id", "page_url", "_s", F.posexplode(items).alias("_i", "it")).filter("coalesce(it.uri, '') <> ''")
    found = found.select("page_id", urls.absolutize(F.col("page_url"), F.col("it.uri")).alias("url"), F.coalesce(F.when(F.col("it.displayName") != "", F.col("it.displayName")), F.col("it.uri")).alias("name"), F.struct("_s", "_i").alias("pos"))
    return best(found.filter("url is not null")).select("page_id", "url", "name", F.lit(0.99).alias("confidence"))


def _group(rows: DataFrame, group: str, label: str, role: str, order: int, most: int) -> DataFrame:
    """Rows (page_id, page_url, url, name, pos) as an ordered group of a page: each URL once, `most` at most, from this site or shown only."""
    once = Window.partitionBy("page_id", F.lower("url")).orderBy("pos")
    df = rows.withColumn("url", urls.normalize_url(F.col("url"), True)).filter("url is not null").withColumn("_k", F.row_number().over(once)).filter("_k = 1")
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("rank") <= most)
    return df.select("page_id", F.lit(group).alias("group_id"), F.lit(label).alias("label"), F.lit(role).alias("role"), F.lit(order).alias("group_order"), "rank", "url", F.trim("name").alias("title"), F.col("page_url").alias("parent_url"), urls.is_display_only(F.col("url"), urls.host(F.col("page_url"))).alias("is_display_only"))


def alerts(pages: DataFrame, most: int = 40, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The messages (url, title) that a page's script hands to its message box, as the group "alerts"; messages of other sites are left out."""
    tail = F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?is)Soleil\.webapps\['InfoMessages'\]\.render(.*)$", 1)
    items = F.from_json(text.json_array_after(tail, '(?i)"messages":'), "array<struct<url:string,title:string>>")
    each = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("page_url"), F.posexplode(items).alias("pos", "it"))
    each = each.withColumn("url", urls.absolutize(F.col("page_url"), F.trim("it.url"))).filter(F.trim("it.url") != "")
    own = each.filter(urls.same_site_host(urls.host(F.col("url")), urls.host(F.col("page_url")))).withColumn("name", F.when(F.trim(F.coalesce("it.title", F.lit(""))) != "", F.col("it.title")).otherwise(F.col("url")))
    return _group(own, "alerts", "Störningar", "Alert", 15, most)


def events(found: DataFrame, most: int = 40) -> DataFrame:
    """Links of a page's event lists and portlets whose block is about an event, as the group "events"; else those after its event heading."""
    own = usable(found).filter(urls.same_site_host(urls.host(F.col("url")), urls.host(F.col("page_url"))))
    first = own.filter(within("event_place") & F.col("eventish") & (F.col("text") != ""))
    other = own.filter(within("event_after")).join(first.select("page_id").distinct(), "page_id", "left_anti")
    return _group(first.unionByName(other), "events", "Evenemang", "Events", 30, most)


def selected(found: DataFrame, name: str, label: str, role: str, order: int, most: int = 40) -> DataFrame:
    """Links that match the selector given to placed_links under a name, as a group of that id."""
    own = usable(found).filter(within(name) & urls.same_site_host(urls.host(F.col("url")), urls.host(F.col("page_url"))))
    return _group(own, name, label, role, order, most)


# ---- template signs -----------------------------------------------------------------------------------------------

# Signs of a page's template; those that begin with "main:" are looked for in its main part.
SIGN_SELECTORS = {
    "has_main": "main, [role=main]",
    "has_breadcrumb": '[class*="breadcrumb"], nav.breadcrumb, .crumbs, [aria-label*="breadcrumb"], [aria-label*="Breadcrumb"]',
    "has_local_nav": '.local-nav, .left-nav, aside nav, [class*="local-nav"], [class*="sidenav"], [class*="sidebar"] nav',
    "has_header_nav": 'header nav, .header nav, [class*="header"] nav, [role=navigation]',
    "h1": "h1",
    "h2": "h2",
    "h3": "h3",
    "time_event": "time[datetime]",
    "pdf_links": 'a[href$=".pdf"], a[href*=".pdf?"]',
    "sections": "main section, main article, main .content-block, main .sv-portlet, main .entry-content > *, main .page-content > *",
    "main:search_in_main": '[class*="search"], [class*="sok"], input[type="search"], form[action*="search"]',
    "main:contact_form": 'form:not([action*="search"])',
    "main:list_items": "ul li, ol li",
    "main:news_class": '[class*="news"], [class*="nyhet"]',
    "main:event_class": '[class*="event"], [class*="kalender"], [class*="aktivitet"]',
    "main:archive_class": '[class*="archive"], [class*="arkiv"]',
    "main:doc_class": '[class*="document"], [class*="dokument"]',
    "main:contact_class": '[class*="contact"], [class*="kontakt"]',
    "main:list_class": '[class*="listing"], [class*="list-view"]',
}


SIGNS = "struct<" + ", ".join(f"{k.removeprefix('main:')}:int" for k in SIGN_SELECTORS) + ", heading:string, body_classes:array<string>>"


def template_signs(html: Column) -> Column:
    """struct of how many elements each sign's selector picks, heading (text of the first h1) and body_classes; each page is read once."""

    def signs(pages):
        import pyarrow as pa

        tests = {k: css.compiled(s) for k, s in SIGN_SELECTORS.items()}
        main_part = css.compiled("main, [role=main]")
        out = []
        for one in pages.to_pylist():
            page = css.Page(one)
            main = next(iter(css.picked(page, main_part)), None)
            row: dict = {k.removeprefix("main:"): (0 if main is None and k.startswith("main:") else len(css.picked(page, t, main if k.startswith("main:") else None))) for k, t in tests.items()}
            row["heading"] = next((page.text(k) for k, n in enumerate(page.nodes) if n.tag == "h1"), "")
            row["body_classes"] = next((n.attrs.get("class", "").split() for n in page.nodes if n.tag == "body"), [])
            out.append(row)
        kinds = [(k.removeprefix("main:"), pa.int32()) for k in SIGN_SELECTORS] + [("heading", pa.string()), ("body_classes", pa.list_(pa.string()))]
        return pa.array(out, pa.struct(kinds))

    signs.__annotations__ = {}
    return F.arrow_udf(signs, SIGNS)(html)
