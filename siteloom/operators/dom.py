"""What needs a page's element tree: blocks of text in reading order, sections, links with the containers they stand in.

Pages go through the standard library's HTML parser in Arrow batches; only the columns asked for reach it. What a browser
would know beside the source (visibility, place on the screen) may be given as columns of the input; by default all is
visible.
"""

from __future__ import annotations

import sys
from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript template svg head".split())
OUTSIDE = frozenset("nav header footer aside form".split())
BLOCKS = frozenset("p li blockquote pre h1 h2 h3 h4 h5 h6 td dt dd figcaption".split())
CONTAINER_BASE = {"breadcrumb": 0.96, "listing": 0.95, "header_nav": 0.93, "nav": 0.91, "aside": 0.87, "group": 0.70, "other": 0.55}
#: Characters of pages that a worker reads before it hands over what it found.
SLICE = 1 << 20
LINKS = "page_id long, pos int, href string, text string, container string, in_main boolean, in_card boolean, n_siblings int, heading string, widget string"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.blocks: list[tuple[str, str]] = []
        self.links: list[dict] = []
        self.heading, self.current, self.anchor, self.children = "", None, None, {}
        self.serial = 0

    def container(self) -> str:
        names = [t for t, _ in self.stack]
        classes = " ".join(f"{a.get('class') or ''} {a.get('id') or ''} {a.get('aria-label') or ''}" for _, a in self.stack).lower()
        if "breadcrumb" in classes:
            return "breadcrumb"
        if "listing" in classes or "page-list" in classes:
            return "listing"
        if "nav" in names:
            return "header_nav" if "header" in names else "nav"
        return "aside" if "aside" in names else "other"

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)
        if tag in BLOCKS and not self.outside():
            self.flush()
            self.current = (tag, [])
        if tag == "a" and "href" in own:
            self.close_anchor()
            parent = self.stack[-2:-1] if self.stack and self.stack[-1][0] == "li" else self.stack[-1:]
            group = parent[0][1].get("_serial", 0) if parent else 0
            names = [t for t, _ in self.stack]
            classes = " ".join(a.get("class") or "" for _, a in self.stack).lower()
            widget = next((a.get("id") or a.get("class") or "" for t, a in reversed(self.stack) if t in ("section", "article", "div") and (a.get("id") or a.get("class"))), "")
            self.children[group] = self.children.get(group, 0) + 1
            self.anchor = {"href": own["href"], "text": [], "container": self.container(), "in_main": "main" in names or "article" in names, "in_card": "card" in classes or "article" in names, "group": group, "heading": self.heading, "widget": widget}
        if tag not in VOID:
            self.serial += 1
            own["_serial"] = self.serial
            self.stack.append((tag, own))

    def handle_startendtag(self, tag, attrs):
        if tag not in VOID:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.close_anchor()
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def outside(self) -> bool:
        return any(t in OUTSIDE or t in SKIPPED for t, _ in self.stack)

    def handle_data(self, data):
        if any(t in SKIPPED for t, _ in self.stack):
            return
        if self.anchor is not None:
            self.anchor["text"].append(data)
        if self.outside():
            return
        if self.current is None and data.strip():
            self.current = ("div", [])
        if self.current is not None:
            self.current[1].append(data)

    def close_anchor(self):
        if self.anchor is not None:
            self.anchor["text"] = " ".join("".join(self.anchor["text"]).split())
            self.links.append(self.anchor)
            self.anchor = None

    def flush(self):
        if self.current is not None:
            tag, parts = self.current
            line = " ".join("".join(parts).split())
            if line:
                self.blocks.append((tag, line))
                if tag[0] == "h" and tag[1:].isdigit():
                    self.heading = line
            self.current = None


def _read(html: str | None) -> _Reader:
    r = _Reader()
    r.feed(html or "")
    r.close()
    r.flush()
    r.close_anchor()
    return r


def _read_in_slices(batches, of, kinds: dict):
    """Batches of a page's id and what `of` makes of its reader; of a batch no more is held as Python's objects than SLICE characters of pages and what they give."""
    import pyarrow as pa

    for b in batches:
        out: list[list] = [[] for _ in kinds]
        held = 0
        for k in range(b.num_rows):
            i, html = b.column(0)[k].as_py(), b.column(1)[k].as_py()
            for row in of(_read(html)):
                for column, v in zip(out, (i, *row)):
                    column.append(v)
            held += len(html or "")
            if held >= SLICE or k == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds.values())], list(kinds))
                out, held = [[] for _ in kinds], 0


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, pos, type (tag), text of the blocks of a page's content in reading order; navigation, header, footer, forms and scripts are left out."""

    def rows(batches):
        import pyarrow as pa

        kinds = {"page_id": pa.int64(), "pos": pa.int32(), "type": pa.string(), "text": pa.string()}
        return _read_in_slices(batches, lambda r: ((pos, tag, line) for pos, (tag, line) in enumerate(r.blocks)), kinds)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(rows, "page_id long, pos int, type string, text string")


def readable(found: DataFrame) -> DataFrame:
    """Blocks without code and without repeats of the block before."""
    w = Window.partitionBy("page_id").orderBy("pos")
    df = found.filter(~text.is_code_like(F.col("text")) | F.col("type").isin("pre"))
    return df.withColumn("_prev", F.lag(F.lower("text")).over(w)).filter(F.col("_prev").isNull() | (F.col("_prev") != F.lower("text"))).drop("_prev")


def sections(found: DataFrame) -> DataFrame:
    """page_id, section (from 0), heading, level, content (blocks) of blocks in order: each heading begins one, what comes before the first is "Top"."""
    head = F.col("type").rlike("^h[1-6]$")
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = found.withColumn("section", F.sum(head.cast("int")).over(w)).withColumn("_h", head)
    g = df.groupBy("page_id", "section").agg(
        F.max(F.when(F.col("_h"), F.col("text"))).alias("heading"), F.max(F.when(F.col("_h"), F.substring("type", 2, 1).cast("int"))).alias("level"),
        F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "type", "text")))).alias("content"),
    )
    return g.select("page_id", F.col("section").cast("int").alias("section"), F.coalesce("heading", F.lit("Top")).alias("heading"), F.coalesce("level", F.lit(0)).alias("level"), F.transform("content", lambda c: F.struct(c["type"].alias("type"), c["text"].alias("text"))).alias("content"))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Links with what surrounds them: container, whether in the main part or a card, links of the same list, last heading, enclosing widget."""

    def of(r: _Reader):
        for pos, a in enumerate(r.links):
            n = r.children[a["group"]]
            container = "group" if a["container"] == "other" and n >= 4 else a["container"]
            yield pos, a["href"], a["text"], container, a["in_main"], a["in_card"], n, a["heading"], a["widget"]

    def rows(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        return _read_in_slices(batches, of, dict(zip((c.split()[0] for c in LINKS.split(", ")), kinds)))

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(rows, LINKS)


def scored_links(found: DataFrame) -> DataFrame:
    """Links with a confidence from their container, their text and their place, 0.05 to 0.999; structural from 0.7."""
    base = F.lit(CONTAINER_BASE["other"])
    for name, value in CONTAINER_BASE.items():
        base = F.when(F.col("container") == name, value).otherwise(base)
    n = F.length("text")
    score = base + F.when((n >= 3) & (n <= 60), 0.02).otherwise(-0.05) - F.when(F.col("pos") > 200, 0.05).otherwise(0.0)
    df = found.withColumn("confidence", F.greatest(F.lit(0.05), F.least(F.lit(0.999), score)))
    return df.withColumn("is_structural", F.col("confidence") >= 0.7)


def by_selector(found: DataFrame, selectors: DataFrame) -> DataFrame:
    """Links of the first selector (rank, container) with at least `least` links on a page; selectors is a small table of rules."""
    met = found.join(F.broadcast(selectors), "container")
    enough = met.groupBy("page_id", "rank", "least").agg(F.count(F.lit(1)).alias("n")).filter("n >= least").groupBy("page_id").agg(F.min("rank").alias("rank"))
    return met.join(enough, ["page_id", "rank"])


def first_per_widget(found: DataFrame) -> DataFrame:
    """Promotion cards: the first link of each widget of a page, under a heading if any is."""
    own = found.filter("widget <> ''")
    return own.groupBy("page_id", "widget").agg(F.min_by(F.struct("href", "text", "heading", "pos"), F.struct((F.col("heading") == "").alias("bare"), "pos")).alias("l")).select("page_id", "widget", "l.*")


def heading_modules(found: DataFrame, patterns: dict[str, str], most: int = 40) -> DataFrame:
    """page_id, module, href, text: links below a heading that matches a pattern, each once, of modules with no more than `most` links."""
    module = F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        module = F.when(F.lower("heading").rlike(p), name).otherwise(module)
    df = found.withColumn("module", module).filter("module is not null")
    once = df.groupBy("page_id", "module", F.lower("href").alias("_k")).agg(F.min_by(F.struct("href", "text", "pos"), "pos").alias("l"))
    small = once.groupBy("page_id", "module").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return once.join(small, ["page_id", "module"], "left_semi").select("page_id", "module", "l.href", "l.text", "l.pos")


def page_links(found: DataFrame, most: int = 2500) -> DataFrame:
    """Links of a page, the visible first, longer texts first, `most` at most. visible: a column of the input, true where absent."""
    df = found if "visible" in found.columns else found.withColumn("visible", F.lit(True))
    w = Window.partitionBy("page_id").orderBy(F.desc("visible"), F.desc(F.length("text")), "pos")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
