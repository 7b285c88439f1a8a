import json

from pyspark.sql import functions as F

import pytest

from siteloom.operators import quality
from siteloom.sources import readers, sinks
from siteloom.streaming import events as st


def test_url_list(spark, tmp_path):
    (tmp_path / "sites.txt").write_text("# c\n\na.se\nhttps://A.se\n b.se \n")
    assert [r.url for r in readers.url_list(spark, str(tmp_path / "sites.txt")).orderBy("ord").collect()] == ["https://a.se", "https://b.se"]
    assert readers.url_lines(spark, ["x.se", "#y", "X.se"]).count() == 1


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = [("https://a.se/sitemap.xml", f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc>https://a.se/s1.xml</loc></sitemap></sitemapindex>"), ("https://a.se/s1.xml", f"<urlset {ns}><url><loc> https://a.se/x </loc></url><url><loc>https://a.se/X</loc></url></urlset>"), ("https://a.se/bad.xml", "<urlset")]
    df = spark.createDataFrame(docs, "url string, xml string")
    roots = spark.createDataFrame([("a", "https://a.se/sitemap.xml")], "site_id string, url string")
    assert readers.sitemap_urls(df, roots).count() == 1
    robots = spark.createDataFrame([("User-agent: *\nSitemap: https://a.se/s.xml\n",)], "text string")
    assert readers.robots_sitemaps(robots).head().sitemap == "https://a.se/s.xml"


def test_rest_pages(spark):
    menu = json.dumps({"items": [{"url": "u", "title": "t", "menu_order": 2}]})
    pages = json.dumps([{"link": "p", "title": {"rendered": "P"}, "menu_order": 1, "status": "publish"}, {"link": "d", "title": {"rendered": "D"}, "menu_order": 1, "status": "draft"}])
    got = readers.rest_pages(spark.createDataFrame([(1, menu), (2, pages)], "id long, json string")).orderBy("id").collect()
    assert [(r.url, r.confidence) for r in got] == [("u", 0.99), ("p", 0.95)]


def test_nav_documents(spark, tmp_path):
    doc = {"host": "A.se", "startUrl": "https://a.se", "flat": [{"url": "https://a.se/x", "title": "X", "parentUrl": "https://a.se", "depth": 1, "isSynthetic": True}, {"url": "https://a.se/y"}]}
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "nav.json").write_text(json.dumps(doc))
    (tmp_path / "run2").mkdir()
    (tmp_path / "run2" / "nav.json").write_text("{ broken")
    df = readers.run_folders(spark, f"{tmp_path}/*/nav.json", readers.NAV_DOCUMENT)
    assert [r.folder for r in df.collect()] == ["run1"]
    items = readers.nav_items(df).orderBy("ord").collect()
    assert (items[0].is_synthetic, items[1].is_synthetic, items[1].title, items[1].depth) == (True, False, "", 0)
    assert readers.folder_size(spark, str(tmp_path)).head().files == 2


LOG = [
    {"runId": "r", "eventName": "page_visit_success", "fields": {"depth": 1, "outlinkCount": "3"}},
    {"runId": "r", "eventName": "page_visit_fail", "url": "u"},
]


def test_event_log_and_profiles(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps(LOG[0]), "", "not json", json.dumps(LOG[1])]))
    e = readers.event_log(spark.read.text(str(tmp_path / "t.jsonl")))
    assert e.count() == 2 and e.filter("eventName = 'page_visit_success'").select(readers.field("outlinkCount", "int").alias("n")).head().n == 3
    runs = spark.createDataFrame([("nav-diagnostic",), ("unknown",), (None,)], "profile string")
    assert sorted(r.max_pages for r in readers.with_profile(runs, readers.profiles(spark)).collect()) == [1, 1, 200]


def test_sinks(spark, tmp_path):
    sinks.write_document({"start_url": "x", "none": None, "list_of": [{"a_b": 1}]}, f"{tmp_path}/d/doc.json")
    assert json.loads((tmp_path / "d" / "doc.json").read_text()) == {"startUrl": "x", "listOf": [{"aB": 1}]}
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    sinks.append_json_lines(df, f"{tmp_path}/log")
    sinks.append_json_lines(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    pre = spark.createDataFrame([("s", 0, "u", "t", 0), ("s", 1, "v", "t", 1), ("s", 2, "w", "t", 1)], "site_id string, pos int, url string, title string, level int")
    assert [c["url"] for c in sinks.nested_tree(pre, "s")[0]["children"]] == ["v", "w"]
    deltas = spark.createDataFrame([("flat", 1, 2, 1, "improved")], "metric string, previous int, current int, delta int, verdict string")
    changes = spark.createDataFrame([("s", "u", "added")], "site_id string, url string, change string")
    assert "- u" in sinks.comparison_markdown(deltas, changes)


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"runId": f"r{i % 2}", "eventName": "page", "fields": {"ord": str(i), "p": f"p{min(i, 12)}"}} for i in range(80)]
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(map(json.dumps, rows[k * 40 : k * 40 + 40])))
    e = st.log_stream(spark, f"{tmp_path}/in")
    counts = st.latest(st.run_once(st.counters(e, ["runId"]), "complete", f"{tmp_path}/c1"), ["runId"])
    assert {r.runId: r.n for r in counts.collect()} == {"r0": 40, "r1": 40}
    own = e.select(F.col("runId").alias("run_id"), readers.field("ord", "long").alias("ord"), readers.field("p").alias("p"))
    live = {r.run_id: r for r in st.latest(st.run_once(st.saturation(own, ["p"], 30), "update", f"{tmp_path}/c2"), ["run_id"]).collect()}
    batch = readers.event_log(spark.read.text(f"{tmp_path}/in")).select(F.col("runId").alias("run_id"), readers.field("ord", "long").alias("ord"), readers.field("p").alias("p"))
    for r in quality.saturation(batch, ["run_id"], ["p"], 30).collect():
        own = live[r.run_id]
        assert (own.pages, own.new_pages, own.new_in_window, own.saturated) == (r.pages, r.new_pages, r.new_in_window, r.saturated)


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "t string, k string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in st.windowed(df, "ts", ["k"]).collect()) == [1, 2]
    assert sorted(r.n for r in st.sessions(df, "ts", ["k"], "25 minutes").collect()) == [1, 2]


def test_entry_imports_without_spark():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 40)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "True"


def test_options_targets_and_log(spark, tmp_path):
    from siteloom.sources import options

    o = options.parsed(["--sites", "s.txt", "--max-pages-per-site", "7", "--cap-gb", "1.5", "--viewport", "800x600", "--keep-query", "--preview", "--no-dated-output"])
    assert (o.input_file, o.max_pages, o.max_bytes, o.viewport, o.drop_query, o.quick_preview, o.dated_output, o.max_depth) == ("s.txt", 7, 3 << 29, (800, 600), False, True, False, 3)
    assert options.parsed([]) == options.Options() and options.parsed(["--max-depth", "0"]).max_depth == 0
    for bad in (["--max-depth", "-1"], ["--max-pages", "0"], ["--viewport", "99x600"], ["--webp-quality", "101"], ["--preview", "--preview-seconds", "0"]):
        with pytest.raises(ValueError):
            options.parsed(bad)
    (tmp_path / "t.json").write_text('{"targets": [{"name": "a", "url": "https://a.se", "expectedCms": "Drupal"}]}')
    assert [(r.name, r.expected_cms, r.profile) for r in options.targets(spark, f"{tmp_path}/none.json", f"{tmp_path}/t.json").collect()] == [("a", "Drupal", None)]
    assert options.targets(spark, f"{tmp_path}/none.json").count() == 0
    lines = []
    with options.EventLog(lines.append).scope("CRAWL", host="a.se", title="two words"):
        pass
    assert lines[0].endswith('EVT CRAWL_START host=a.se title="two words"') and " EVT CRAWL_END host=a.se" in lines[1] and "ms=" in lines[1]


def test_sitemap_roots(spark):
    sites = spark.createDataFrame([("a", "https://a.se/x"), ("b", "https://b.se"), ("c", "https://c.se")], "site_id string, start_url string")
    robots = spark.createDataFrame([("a", "User-agent: *\nSitemap: https://a.se/m.xml"), ("b", "User-agent: *")], "site_id string, text string")
    docs = spark.createDataFrame([("https://b.se/sitemap_index.xml",), ("https://a.se/sitemap.xml",)], "url string")
    assert sorted(tuple(r) for r in readers.sitemap_roots(sites, robots, docs).collect()) == [("a", "https://a.se/m.xml"), ("b", "https://b.se/sitemap_index.xml")]


class _Kept:
    """A state of one run, and how often it was asked."""

    def __init__(self):
        self.rows, self.value, self.asked = {}, None, 0

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.rows

    def updateValue(self, key, value):
        self.asked += 1
        self.rows[key] = value


def test_stream_asks_its_state_once_for_each_pattern():
    import random

    import pandas as pd

    r = random.Random(3)
    s = st.Saturation(7, 2)
    s.seen, s.recent = _Kept(), _Kept()
    seen, flags, pages = set(), [], 0
    for low, size, n in ((0, 2000, 40), (2000, 2, 200), (2002, 5, 200), (2007, 300, 3)):
        batch = [(low + i, r.choice(["a", "A", "b", " ", None, f"p{r.randrange(n)}"]), r.choice(["x", "b", None])) for i in range(size)]
        for _, *ps in batch:
            fresh = {(k, p.lower()) for k, p in enumerate(ps) if p is not None and p.strip()} - seen
            seen, flags, pages = seen | fresh, flags + [bool(fresh)], pages + 1
        r.shuffle(batch)
        df = pd.DataFrame(batch, columns=["ord", "p0", "p1"])
        got = next(s.handleInputRows(("u",), iter([df[:150], df[150:]]), None)).iloc[0]
        assert (got.pages, got.new_pages, got.new_in_window, got.saturated) == (pages, sum(flags), sum(flags[-7:]), pages >= 7 and not any(flags[-7:]))
    assert {k for k, in s.seen.rows} == {f"{k}:{p}" for k, p in seen} and s.seen.asked + s.recent.asked < 400
