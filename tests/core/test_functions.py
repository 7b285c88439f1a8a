import pytest
from pyspark.sql import functions as F

from siteloom.functions import text, urls


def ev(spark, fn, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"a{i} string" for i in range(len(args))))
    return df.select(fn(*(F.col(f"a{i}") for i in range(len(args)))).alias("r")).head().r


@pytest.mark.parametrize(
    "fn,args,want",
    [
        (urls.ensure_scheme, (" a.se ",), "https://a.se"),
        (urls.ensure_scheme, ("HTTP://a.se",), "HTTP://a.se"),
        (lambda c: urls.normalize_url(c, True), ("HTTPS://A.se:443/x/?q=1#f",), "https://a.se/x"),
        (lambda c: urls.normalize_url(c, False), ("http://a.se/x/?q=1#f",), "http://a.se/x/?q=1"),
        (lambda c: urls.normalize_url(c, True), (" not a url ",), "not a url"),
        (urls.canonical_key, ("http://A.se:80/X/#f",), "http://a.se/x"),
        (urls.absolutize, ("https://a.se/d/e", "f?x=1"), "https://a.se/d/f?x=1"),
        (urls.absolutize, ("https://a.se/d/e/", "../g"), "https://a.se/d/g"),
        (urls.absolutize, ("https://a.se/d/e", "/../../h"), "https://a.se/h"),
        (urls.absolutize, ("https://a.se/d/e", "//b.se/i"), "https://b.se/i"),
        (urls.absolutize, ("https://a.se/d/e", "?p=2"), "https://a.se/d/e?p=2"),
        (urls.absolutize, ("https://a.se/d/e", "."), "https://a.se/d/"),
        (urls.absolutize, ("https://a.se", "mailto:x@y"), None),
        (urls.absolutize, ("https://a.se", "#x"), None),
        (urls.is_binary_asset, ("https://a.se/x.PDF?y",), True),
        (urls.is_binary_asset, ("/x.html",), False),
        (urls.pretty_segment, ("a-b_c",), "A b c"),
        (urls.host_to_site_name, ("www.kommun.se",), "Kommun"),
        (urls.path_segment_count, ("https://a.se//b/c/",), 2),
        (urls.path_segment_count, ("nope",), 0),
        (urls.normalize_path, ("a//b/",), "/a/b"),
        (urls.section_prefix, ("/x.2142.html",), "/x"),
        (urls.is_url_descendant, ("https://a.se/x.12.html", "https://www.a.se/x/y"), True),
        (urls.is_url_descendant, ("https://a.se/x", "https://a.se/xy"), False),
        (urls.is_url_descendant, ("https://a.se/", "https://a.se/x"), False),
        (urls.immediate_prefix_url, ("https://a.se:8080/b/c",), "https://a.se/b"),
        (urls.immediate_prefix_url, ("https://a.se/b",), None),
        (urls.last_path_segment, ("https://a.se/b/c/",), "c"),
        (urls.is_numeric_or_date_slug, ("2024-05",), True),
        (urls.is_numeric_or_date_slug, ("",), True),
        (urls.is_numeric_or_date_slug, ("x1",), False),
        (urls.slug_to_title, ("lediga-jobb",), "Lediga jobb"),
        (urls.is_raw_url_title, ("/x", "https://a.se/x"), True),
        (lambda t, u: urls.is_raw_url_title(t, u, True), ("A.se", "https://www.a.se/x"), True),
        (urls.display_title, ("https://a.se/min-sida", "https://a.se/min-sida"), "Min sida"),
        (urls.display_title, ("", "https://www.kommun.se"), "Kommun"),
        (urls.is_noise_path, ("/a/RSS",), True),
        (urls.is_noise_path, ("/wp-json/x",), True),
        (urls.is_noise_path, ("/a",), False),
        (urls.is_dated_or_article_url, ("https://a.se/2024/05/x",), True),
        (urls.is_dated_or_article_url, ("x",), True),
        (urls.is_dated_or_article_url, ("https://a.se/skola",), False),
        (urls.is_display_only, ("https://a.se/a/b/c", "a.se"), True),
        (urls.is_display_only, ("https://a.se/2024-x", "a.se"), True),
        (urls.is_display_only, ("https://a.se/x", "a.se"), False),
        (urls.is_start_page_alias, ("https://a.se/Index.html", "https://a.se"), True),
        (urls.path_shape, ("https://a.se/x/2024/123/en-lang-slug/abc",), "/x/{year}/{id}/{slug}/abc"),
        (urls.path_shape, ("https://a.se",), "/"),
        (text.fold_text, ("Ärende – Om|Å",), "arende - om a"),
        (text.collapse_whitespace, (" a \n b ",), "a b"),
        (text.page_title, ("<title> A &amp; B\n</title>",), "A & B"),
        (text.generator, ('<meta name="generator" content="WordPress 6">',), "wordpress 6"),
        (text.is_natural_text, ("Det här är en mening.",), True),
        (text.is_code_like, ("x" * 250,), True),
        (lambda c: text.json_array_after(c, "items"), ('var items = [{"a":"]"},[1,2]]; [9]',), '[{"a":"]"},[1,2]]'),
        (lambda c: text.json_array_after(c, "items"), ("items = [1, 2",), None),
    ],
)
def test_value(spark, fn, args, want):
    assert ev(spark, fn, *args) == want


def test_ancestors(spark):
    assert ev(spark, urls.ancestor_urls, "https://A.se/b/c/d") == ["https://a.se/b/c", "https://a.se/b"]
    assert ev(spark, urls.ancestor_urls, "https://a.se/b") == []
