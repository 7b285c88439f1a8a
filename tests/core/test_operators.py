"""Hand-made cases for the operators that the driver's tables don't exercise."""

import json

import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import classify, compare, dom, fingerprint, frontier, hierarchy, links, quality, tree

S = "https://a.se"
ITEM = "site_id string, ord long, url string, title string, parent_url string, depth int, start_url string"


def items(spark, rows):
    return spark.createDataFrame([("a", i, S + u, t, S + p if p is not None else "", d, S) for i, (u, t, p, d) in enumerate(rows)], ITEM)


def test_dedup_keeps_best_row_and_title(spark):
    df = items(spark, [("", "Start", None, 0), ("/X", S + "/X", "", 0), ("/x/", "Section X", "/y", 2), ("/y", "Y", "", 1)])
    out = {r.url: r for r in hierarchy.dedup_items(df).collect()}
    assert len(out) == 3 and out[S + "/x"].title == "Section X" and out[S + "/x"].parent_url == S + "/y" and out[S + "/x"].ord == 1


def test_cycles_unknown_parents_and_depths(spark):
    df = items(spark, [("", "Start", None, 0), ("/a", "A", "", 5), ("/a/b", "B", "/a", 9), ("/p", "P", "/q", 1), ("/q", "Q", "/p", 1), ("/a/b/c", "C", "/gone", 1), ("/self", "Self", "/self", 1)])
    out = {urls_path(r.url): r for r in hierarchy.finalise(df).collect()}
    assert {k: r.depth for k, r in out.items()} == {"": 0, "/a": 1, "/a/b": 2, "/p": 1, "/q": 1, "/a/b/c": 3, "/self": 1}
    assert out["/a/b/c"].parent_url == S + "/a/b" and out["/self"].parent_url == S and out[""].parent_url == ""


def urls_path(u):
    return u.removeprefix(S)


def test_reparenting_prefers_the_longest_section(spark):
    df = items(spark, [("", "Start", None, 0), ("/skola.12.html", "Skola", "", 1), ("/skola/lov", "Lov", "", 1), ("/skola/lov/sommar", "Sommar", "", 1), ("/ensam/sida", "Sida", "", 1)])
    out = {urls_path(r.url): r for r in hierarchy.reparent_orphans(df, df.filter("depth = 1")).collect()}
    assert out["/skola/lov"].parent_url == S + "/skola.12.html" and out["/skola/lov/sommar"].parent_url == S + "/skola/lov"
    assert out["/ensam/sida"].parent_url == S and not out["/ensam/sida"].parent_accepted


def test_synthetic_parents(spark):
    rows = [("", "Start", None, 0)] + [(u, u, "", 1) for u in ("/bygga/bo", "/bygga/riva", "/ett/barn", "/2024/a", "/2024/b", "/d/e/f", "/d/e/g")]
    out = {urls_path(r.url): r for r in hierarchy.insert_synthetic_parents(items(spark, rows)).collect()}
    assert out["/bygga"].is_synthetic and out["/bygga"].title == "Bygga" and out["/bygga/bo"].parent_url == S + "/bygga"
    assert "/ett" not in out and "/2024" not in out and out["/d/e/f"].parent_url == S + "/d/e"


def test_tree_with_two_parents_and_a_cycle(spark):
    df = items(spark, [("", "Start", None, 0), ("/a", "A", "", 1), ("/b", "B", "", 1), ("/c", "C", "/a", 2), ("/c", "", "/b", 2), ("/c/d", "D", "/c", 3), ("/a", "A2", "/c/d", 4)])
    assert tree.node_counts(df).head().tree_nodes == 1 + 2 + 2 + 2 + 1
    order = [urls_path(r.url) for r in tree.preorder(df).orderBy("pos").collect()]
    assert order[:4] == ["", "/a", "/c", "/c/d"] and order.count("/c/d") == 2
    assert {urls_path(r.url) for r in tree.search(df, "d").select("url").collect()} >= {"", "/a", "/b", "/c", "/c/d"}


def test_tree_by_depth(spark):
    df = items(spark, [("/r", "", None, 0), ("/x", "", None, 1), ("/y", "", None, 2), ("/z", "", None, 1)])
    assert {urls_path(r.url): urls_path(r.parent_url) for r in tree.by_depth(df).collect()} == {"/r": "", "/x": "/r", "/y": "/x", "/z": "/r"}


def test_invariants_on_random_sites(spark):
    import random

    r = random.Random(6)
    paths = sorted({"/" + "/".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(15)})
    df = items(spark, [("", "Start", None, 0)] + [(p, p, r.choice(["", *paths]), r.randrange(4)) for p in paths for _ in range(r.randrange(1, 3))])
    out = hierarchy.finalise(hierarchy.insert_synthetic_parents(df)).collect()
    parent = {r_.url: r_.parent_url for r_ in out}
    assert len(parent) == len(out) and all((r_.depth == 0) == (r_.url == S) for r_ in out)
    for u in parent:
        seen = set()
        while u != S:
            assert u not in seen and u in parent
            seen.add(u)
            u = parent[u]


def test_links(spark):
    html = '<a href="">e</a><a href="#x">h</a><a href="javascript:1">j</a><a href="mailto:a@b">m</a><a href="tel:1">t</a><a href="http://b.se/x">b</a><a href="/f.pdf">p</a><a href="/wp-admin/x">w</a><a href="/ok?q=1">o <b>k</b></a><a href="ok">d</a><a href="http:// bad">i</a>'
    df = spark.createDataFrame([(1, S + "/", html)], "page_id long, url string, html string")
    got = {r.pos: r.reason for r in links.classified(links.anchors(df)).collect()}
    assert [got[k] for k in range(11)] == ["empty_href", "hash_link", "javascript_link", "mailto", "tel", "external_host", "binary_asset", "noise_path", None, "duplicate", "invalid_url"]
    sample = spark.createDataFrame([(1, i, f"u{i}") for i in range(10)], "page_id long, pos int, url string")
    assert sorted(r.pos for r in links.spread_sample(sample, ["page_id"], ["pos"], 4).collect()) == [0, 3, 6, 9]
    assert links.spread_sample(sample, ["page_id"], ["pos"], 0).count() == 10 and links.spread_sample(sample, ["page_id"], ["pos"], 1).count() == 1


@pytest.mark.parametrize(
    "html,want",
    [
        ("/wp-content/ and sv-portlet /sitevision/", ("WordPress", "medium")), ("/sitevision/ svDocReady AppRegistry sv-portlet", ("SiteVision", "high")), ("sv-portlet", ("Unknown", "low")),
        ("drupalSettings", ("Drupal", "medium")), ('<meta name="generator" content="Umbraco"> umb-x', ("Umbraco", "high")), ("episerver optimizely", ("Optimizely", "medium")), ("/sitecore/ x", ("Sitecore", "medium")),
    ],
)
def test_cms(spark, html, want):
    r = spark.createDataFrame([(html,)], "h string").select(classify.detect_cms(F.col("h")).alias("c")).head().c
    assert (r.kind, r.confidence) == want


def test_root_class(spark):
    cases = [
        ("/index.html", "Start", "", "HomepageModuleRoot"), ("/kontakt", "Kontakt", "", "UtilityRoot"), ("/sidan", "404", "", "ErrorOrSystemRoot"), ("/portal", "Portal", "", "MicrositeRoot"), ("/nyheter", "Nyheter", "", "NewsOrEventRoot"),
        ("/anslagstavla", "Anslagstavla", "", "UtilityRoot"), ("/anslagstavla", "Anslagstavla", "primary_nav", "EligibleStructuralRoot"), ("/barn-och-utbildning", "Barn och utbildning", "", "EligibleStructuralRoot"),
        ("/xyz", "Xyz", "homepage_anchor", "HomepageModuleRoot"), ("/xyz", "Xyz", "is_synthetic", "DiscoveredOtherRoot"), ("/xyz", "Xyz", "", "DiscoveredOtherRoot"),
    ]
    df = spark.createDataFrame([(i, S + p, t, S, f, w) for i, (p, t, f, w) in enumerate(cases)], "i int, u string, t string, s string, f string, want string")
    flags = {k: F.col("f") == k for k in ("is_synthetic", "primary_nav", "homepage_anchor")}
    got = df.select("i", "want", classify.root_class(F.col("u"), F.col("t"), F.col("s"), flags)["kind"].alias("kind")).collect()
    assert [r.kind for r in got] == [r.want for r in got]


def test_homepage_anchor_scores(spark):
    rows = [(S + "/skola", "Skola", "a.se", True, True, True, 5), (S + "/skola/lov", "Lov", "a.se", True, True, True, 5), ("https://b.se/x", "X", "a.se", False, False, True, 0)]
    df = spark.createDataFrame(rows, "url string, title string, site_host string, in_main boolean, in_card boolean, visible boolean, n_siblings int")
    got = [r.homepage_accepted for r in classify.score_homepage_anchors(df).collect()]
    assert got == [True, False, False]


def test_fingerprint_and_sections(spark):
    html = '<html><body class="page-template-x foo wp-y"><nav><a href="/n">N</a></nav><main><p>Intro text.</p><h1>Rubrik</h1><p>One.</p><p>One.</p><h2>Under</h2><ul><li>a</li><li>b</li></ul></main></body></html>'
    df = spark.createDataFrame([(1, S + "/x/2024", html)], "page_id long, url string, html string")
    f = fingerprint.fingerprints(df).head()
    assert f.classes == ["page-template-x", "wp-y"] and f.heading_shape == "h1:1,h2:1,h3:0" and f.has_main and len(f.fingerprint) == 16
    got = [(r.section, r.heading, r.level, [c.text for c in r.content]) for r in dom.sections(dom.readable(dom.blocks(df))).orderBy("section").collect()]
    assert got == [(0, "Top", 0, ["Intro text."]), (1, "Rubrik", 1, ["One."]), (2, "Under", 2, ["a", "b"])]
    link = dom.scored_links(dom.links(df)).head()
    assert link.container == "nav" and link.is_structural


def test_crawl_budgets(spark):
    edges = [("/", "/a", 0), ("/", "/b", 1), ("/", "/c", 2), ("/a", "/d", 0), ("/b", "/d", 0), ("/b", "/e", 1), ("/d", "/", 0), ("/d", "/f", 1)]
    links_ = spark.createDataFrame([("s", a, b, p) for a, b, p in edges], "site_id string, url string, target string, pos int")
    start = spark.createDataFrame([("s", "/")], "site_id string, url string")
    full = [(r.url, r.depth, r.parent_url) for r in frontier.crawl(start, links_).orderBy("ord").collect()]
    assert full == [("/", 0, ""), ("/a", 1, "/"), ("/b", 1, "/"), ("/c", 1, "/"), ("/d", 2, "/a"), ("/e", 2, "/b"), ("/f", 3, "/d")]
    assert frontier.crawl(start, links_, max_pages=3).count() == 3 and frontier.crawl(start, links_, pages_per_depth=1).count() == 4 and frontier.crawl(start, links_, max_depth=1).count() == 4


def test_parent_rules(spark):
    rows = [(S, S + "/a", S, False), (S + "/a", S + "/a/b", S, True), (S + "/a", S + "/x", S, False)]
    df = spark.createDataFrame(rows, "p string, c string, s string, st boolean")
    attach = df.select(frontier.should_attach(F.col("p"), F.col("c"), F.col("s"), F.lit(False), F.col("st")).alias("r")).collect()
    assert [r.r for r in attach] == [True, True, False]
    up = lambda cur, new, a=False, b=False: spark.range(1).select(frontier.should_upgrade(F.lit(cur), F.lit(new), F.lit(a), F.lit(b), F.lit(S)).alias("r")).head().r
    assert up(S, S + "/a") and not up(S + "/a", S) and not up(S + "/a", S + "/a/b") and up(S + "/a/b", S + "/a") and up(S + "/a", S + "/z", False, True)


def test_events_and_saturation(spark):
    rows = [("r", i, f"p{min(i, 9)}", "t") for i in range(60)]
    e = spark.createDataFrame(rows, "run_id string, ord long, pattern string, kind string")
    s = quality.saturation(e, ["run_id"], ["pattern", "kind"], 50).head()
    assert (s.pages, s.new_pages, s.new_in_window, s.saturated) == (60, 10, 0, True)
    assert not quality.saturation(e.filter("ord < 40"), ["run_id"], ["pattern"], 50).head().saturated
    log = spark.createDataFrame([("r", "link_rejected", "mailto", None), ("r", "link_rejections_summary", None, {"mailto": 1, "tel": 2})], "run_id string, event string, reason string, reasons map<string,int>")
    assert {r.reason: r.n for r in quality.rejections(log).collect()} == {"mailto": 1, "tel": 2}
    assert {r.reason: r.n for r in quality.rejections(log, compat=True).collect()} == {"mailto": 2, "tel": 2}


def test_metrics_and_warnings(spark):
    df = items(spark, [("", "Start", None, 0)] + [(f"/a/{i}", "T", "", 1) for i in range(25)] + [("/z", "/z", "/gone", 1)]).withColumn("is_synthetic", F.lit(False))
    m = quality.nav_metrics(df).head()
    assert (m.flat, m.deep, m.orphans, m.duplicate_titles, m.verdict) == (27, 25, 1, 1, "FAIL")
    codes = {r.code: r.severity for r in quality.warnings(quality.nav_metrics(df), ["site_id"]).collect()}
    assert codes["root_leaf_pollution"] == "error" and "no_pages_found" not in codes


@pytest.mark.parametrize("metric,old,new,want", [("flatPageCount", 100, 90, "regressed"), ("flatPageCount", 100, 91, "unchanged"), ("flatPageCount", 0, 5, "improved"), ("timeoutCount", 10, 13, "regressed"), ("timeoutCount", 0, 9, "unchanged"), ("timeoutCount", 9, 0, "improved"), ("treeNodeCount", 5, 5, "unchanged")])
def test_deltas(spark, metric, old, new, want):
    make = lambda v: spark.createDataFrame([("s", metric, v)], "site_id string, metric string, value long")
    assert compare.metric_deltas(make(old), make(new), ["site_id"]).head().verdict == want


def gate(spark, **change):
    row = dict(profile="nav-diagnostic", has_report=True, quality_errors=0, flat=10, regressed=[], improved=[], cms_changed=False, group_changed=False, cms="x", nav_groups=1, tree_nodes=1, fingerprints=1, saturated=True, lost_saturation=False, template_regression=False, review_flags=0, url_changes=0) | change
    kinds = "profile string, has_report boolean, quality_errors int, flat int, regressed array<string>, improved array<string>, cms_changed boolean, group_changed boolean, cms string, nav_groups int, tree_nodes int, fingerprints int, saturated boolean, lost_saturation boolean, template_regression boolean, review_flags int, url_changes int"
    return compare.gate(spark.createDataFrame([tuple(row.values())], kinds)).head().decision


def test_gate(spark):
    assert gate(spark) == "accepted" and gate(spark, flat=0) == "rejected" and gate(spark, cms_changed=True) == "review"
    assert gate(spark, regressed=["flatPageCount"]) == "rejected" and gate(spark, regressed=["flatPageCount"], improved=["orphanPageCount"]) == "review"
    assert gate(spark, profile="smoke", regressed=["treeNodeCount"]) == "accepted" and gate(spark, quality_errors=1, cms_changed=True) == "rejected"


def test_comparisons(spark):
    a = spark.createDataFrame([("s", S + "/A", "p"), ("s", S + "/b", "p")], "site_id string, url string, parent_url string")
    b = spark.createDataFrame([("s", S + "/a", "P"), ("s", S + "/c", "q"), ("s", S + "/C", "q")], "site_id string, url string, parent_url string")
    assert sorted((r.change, r.url.lower()) for r in compare.url_changes(a, b, ["site_id"]).collect()) == [("added", S + "/c"), ("removed", S + "/b")]
    assert compare.parent_changes(a, b, ["site_id"]).count() == 0
    assert json.dumps(urls.path_shape.__name__)


def test_deep_paths_and_long_parent_chains_are_kept(spark):
    start, deep = "https://a.org", 15
    rows = [("s", 0, start, "", start)]
    for d in range(1, deep):
        prefix = start + "".join(f"/part{k}" for k in range(d + 1))
        rows += [("s", 2 * d + i, f"{prefix}/{x}page", start, start) for i, x in enumerate("ab")]
    made = hierarchy.insert_synthetic_parents(spark.createDataFrame(rows, "site_id string, ord long, url string, parent_url string, start_url string"))
    assert {r.url.count("/part") for r in made.filter("is_synthetic").collect()} == set(range(2, deep + 1))

    long = 70
    rows = [("s", 0, start, "", "t", start)] + [("s", k, f"{start}/p{k}", f"{start}/p{k - 1}" if k > 1 else start, "t", start) for k in range(1, long + 1)]
    rows.append(("s", long + 1, f"{start}/p1", f"{start}/p2", "t", start))  # a second row that leads around
    chain = spark.createDataFrame(rows, "site_id string, ord long, url string, parent_url string, title string, start_url string").coalesce(1)
    assert {(r.url, r.depth) for r in hierarchy.recompute_depths(chain).collect()} == {(start, 0)} | {(f"{start}/p{k}", k) for k in range(1, long + 1)}
    counts = tree.node_counts(chain.filter(f"ord <= {long}")).head()
    assert (counts.tree_nodes, counts.max_level) == (long + 1, long)


def test_frontier_query_goes_past_twenty_pages_and_two_levels(spark, tmp_path):
    from siteloom.plans.queries import frontier_bfs

    link = lambda *paths: "".join(f'<a href="https://a.org{p}">{p}</a>' for p in paths)
    rows = [(0, "https://a.org/", link(*(f"/p{k}" for k in range(30)))), (1, "https://a.org/p0", link("/q")), (2, "https://a.org/q", link("/r"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.url: r.depth for r in frontier_bfs(spark, str(tmp_path)).collect()}
    assert len(got) == 33 and got["https://a.org/q"] == 2 and got["https://a.org/r"] == 3


class _Taken:
    """Stands for a table of pages; gives the function that workers run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, rows, schema):
        return rows


@pytest.mark.parametrize("read,per_page", [(dom.blocks, 3), (dom.links, 1)])
def test_workers_hold_no_more_than_a_slice_of_pages(spark, read, per_page):
    import tracemalloc

    import pyarrow as pa

    n, page = 200, "<p>" + "x" * 100_000 + "</p><p><a href='/a'>" + "y" * 20_000 + "</a></p><h2>z</h2>"
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([page] * (n - 1) + [None], pa.string())], ["page_id", "html"]), pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], ["page_id", "html"])]
    rows = read(_Taken())
    tracemalloc.start()
    try:
        ids = [i for b in rows(iter(batches)) for i in b.column("page_id").to_pylist()]
        assert tracemalloc.get_traced_memory()[1] < 8e6
    finally:
        tracemalloc.stop()
    assert ids == [i for i in range(n - 1) for _ in range(per_page)]
