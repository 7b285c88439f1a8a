"""URL functions over columns.

A URL is taken apart by one regular expression. Keys are lower-cased in scheme and host and are not percent-encoded or
decoded; a default port goes. What is no absolute http(s) URL is returned trimmed, and has no host and no path segments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions import vocab

URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#:\s]+)(:[0-9]+)?([^?#]*)([?][^#]*)?(#.*)?$"


def _part(c: Column, k: int) -> Column:
    return F.regexp_extract(c, URL, k)


def is_absolute(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(URL)


def scheme(c: Column) -> Column:
    return F.lower(_part(c, 1))


def host(c: Column) -> Column:
    return F.lower(_part(c, 2))


def path(c: Column) -> Column:
    """The path; `/` where a URL has none."""
    p = F.trim(_part(c, 4))
    return F.when(is_absolute(c) & (p == ""), F.lit("/")).otherwise(p)


def port(c: Column) -> Column:
    """The port with its colon, empty for the scheme's own."""
    p = _part(c, 3)
    return F.when(((scheme(c) == "http") & (p == ":80")) | ((scheme(c) == "https") & (p == ":443")), F.lit("")).otherwise(p)


def origin(c: Column) -> Column:
    return F.concat(scheme(c), F.lit("://"), host(c), port(c))


def _untrailed(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def ensure_scheme(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when((t == "") | F.lower(t).rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def normalize_url(c: Column, drop_query: bool) -> Column:
    """Without fragment, and query if asked, and trailing slashes."""
    query = F.lit("") if drop_query else _part(c, 5)
    return F.when(is_absolute(c), _untrailed(F.concat(origin(c), path(c), query))).otherwise(F.trim(F.coalesce(c, F.lit(""))))


def canonical_url(c: Column) -> Column:
    """Without fragment, query, default port and trailing slashes."""
    return F.when(is_absolute(c), _untrailed(F.concat(origin(c), path(c)))).otherwise(_untrailed(F.trim(F.coalesce(c, F.lit("")))))


def canonical_key(c: Column) -> Column:
    return F.lower(canonical_url(c))


def without_dots(p: Column) -> Column:
    """A path with its `.` and `..` segments resolved."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    return F.when(~p.rlike(r"(^|/)\.\.?(/|$)"), p).otherwise(F.when(last.isin(".", "..") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined))


def absolutize(base: Column, href: Column) -> Column:
    """The URL that a link means on a page; null for blank, mailto, tel, javascript and fragment links."""
    h = F.trim(F.coalesce(href, F.lit("")))
    low = F.lower(h)
    own_path, query = F.regexp_extract(h, r"^([^?#]*)", 1), F.regexp_extract(h, r"([?#].*)$", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return (
        F.when((h == "") | low.rlike("^(mailto|tel|javascript):") | h.startswith("#"), F.lit(None).cast("string"))
        .when(is_absolute(h), F.concat(origin(h), without_dots(path(h)), _part(h, 5), _part(h, 6)))
        .when(low.rlike("^[a-z][a-z0-9+.-]*:"), h)
        .when(~is_absolute(base), F.lit(None).cast("string"))
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("?"), F.concat(origin(base), path(base), h))
        .when(h.startswith("/"), F.concat(origin(base), without_dots(own_path), query))
        .otherwise(F.concat(origin(base), without_dots(F.concat(folder, own_path)), query))
    )


def is_http_url(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("^https?://")


def is_binary_asset(c: Column) -> Column:
    """c: a path or a URL."""
    p = F.lower(F.trim(F.when(is_absolute(c), path(c)).otherwise(F.coalesce(c, F.lit("")))))
    return p.rlike(r"[.](" + "|".join(vocab.BINARY_EXTENSIONS) + ")$")


def page_file_key(c: Column) -> Column:
    return F.concat(F.lit("p_"), F.sha1(normalize_url(c, True)))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def pretty_segment(c: Column) -> Column:
    s = F.translate(F.trim(F.coalesce(c, F.lit(""))), "-_", "  ")
    return F.when(F.trim(s) == "", F.lit("(empty)")).otherwise(capitalised(s))


def host_to_site_name(h: Column) -> Column:
    t = F.regexp_replace(F.trim(F.coalesce(h, F.lit(""))), "(?i)^www[.]", "")
    first = F.regexp_extract(t, r"^[.]*([^.]+)", 1)
    return F.when(first == "", F.coalesce(h, F.lit(""))).otherwise(capitalised(first))


def path_segments(c: Column) -> Column:
    return F.filter(F.split(F.when(is_absolute(c), path(c)).otherwise(F.lit("")), "/"), lambda x: x != "")


def path_segment_count(c: Column) -> Column:
    return F.size(path_segments(c))


def normalize_path(p: Column) -> Column:
    t = F.trim(F.coalesce(p, F.lit("")))
    one = F.regexp_replace(F.concat(F.lit("/"), t), "/+", "/")
    return F.when(F.length(one) > 1, F.regexp_replace(one, "/$", "")).otherwise(one)


def section_prefix(p: Column) -> Column:
    """A path without `.html` and without a page number before that."""
    return F.regexp_replace(F.regexp_replace(normalize_path(p), "(?i)[.]html$", ""), "^(.+)[.][0-9]+$", "$1")


def same_site_host(a: Column, b: Column) -> Column:
    bare = lambda x: F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "^www[.]", "")
    return bare(a) == bare(b)


def is_url_descendant(parent: Column, child: Column) -> Column:
    """Whether child lies below the section of parent on the same site. The root has no descendants by this test."""
    below = F.lower(normalize_path(path(child))).startswith(F.lower(F.concat(section_prefix(path(parent)), F.lit("/"))))
    return is_absolute(parent) & is_absolute(child) & same_site_host(host(parent), host(child)) & below


def immediate_prefix_url(c: Column) -> Column:
    """The URL one segment up; null for fewer than two segments. A port is dropped."""
    s = path_segments(c)
    return F.when(F.size(s) >= 2, F.concat(scheme(c), F.lit("://"), host(c), F.lit("/"), F.array_join(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), "/")))


def ancestor_urls(c: Column) -> Column:
    """URLs of all proper path prefixes, the nearest first."""
    s = path_segments(c)
    n = F.size(s)
    ups = F.when(n >= 2, F.sequence(n - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.transform(ups, lambda k: F.concat(scheme(c), F.lit("://"), host(c), F.lit("/"), F.array_join(F.slice(s, F.lit(1), k), "/")))


def last_path_segment(c: Column) -> Column:
    return F.when(is_absolute(c), F.regexp_extract(F.regexp_replace(path(c), "/+$", ""), "([^/]*)$", 1)).otherwise(F.coalesce(c, F.lit("")))


def is_numeric_or_date_slug(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike(r"^([0-9]*|[0-9]{4}(-[0-9]{2}){0,2})$")


def slug_to_title(c: Column) -> Column:
    return capitalised(F.translate(c, "-", " "))


def humanized_slug(c: Column) -> Column:
    """The last path segment as words, with marks put back into known ones and a capital at the start; the URL itself where there is none."""
    words = F.regexp_replace(F.try_element_at(path_segments(c), F.lit(-1)), "-", " ")
    for plain, written in vocab.SLUG_REPAIRS:
        words = F.regexp_replace(words, rf"(?iu)\b{plain}\b", written)
    return F.coalesce(F.when(F.trim(words) != "", F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))), c)


def is_raw_url_title(title: Column, url: Column, hosts_too: bool = False) -> Column:
    """Whether a title is no more than an address. hosts_too: also if it is the host, with or without www."""
    t = F.trim(F.coalesce(title, F.lit("")))
    raw = (t == "") | F.lower(t).rlike("^(https?://|/)") | (F.lower(t) == F.lower(F.coalesce(url, F.lit(""))))
    if hosts_too:
        raw = raw | (is_absolute(url) & ((F.lower(t) == host(url)) | (F.concat(F.lit("www."), F.lower(t)) == host(url))))
    return raw


def display_title(title: Column, url: Column) -> Column:
    last = F.element_at(path_segments(url), -1)
    return (
        F.when(~is_raw_url_title(title, url, True), F.trim(title))
        .when(path_segment_count(url) > 0, slug_to_title(last))
        .when(is_absolute(url), host_to_site_name(host(url)))
        .otherwise(F.trim(F.coalesce(url, title, F.lit(""))))
    )


def display_title_reason(title: Column, url: Column) -> Column:
    return F.when(~is_raw_url_title(title, url, True), F.lit("trusted_title")).when(path_segment_count(url) > 0, F.lit("humanized_slug")).otherwise(F.lit("url_fallback"))


def _any(c: Column, tokens) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | c.contains(t)
    return out


def is_noise_path(p: Column, notices: str = vocab.NOTICE_SECTION) -> Column:
    """Whether a path leads to what isn't worth reading. notices: NOTICE_SECTION, or NOTICE_ARTICLE where the section's own page is."""
    low = F.lower(_untrailed(F.coalesce(p, F.lit(""))))
    out = low.isin(*vocab.NOISE_EQUAL) | _any(low, [notices if t == vocab.NOTICE_SECTION else t for t in vocab.NOISE_INSIDE])
    for t in vocab.NOISE_START:
        out = out | low.startswith(t)
    for t in vocab.NOISE_END:
        out = out | low.endswith(t)
    return out


def is_dated_or_article_url(c: Column) -> Column:
    p = F.lower(path(c))
    return ~is_absolute(c) | p.rlike(r"/20[0-9]{2}([-/][0-9]{2})?([-/][0-9]{2})?(/|$)") | _any(p, vocab.ARTICLE_TOKENS)


def is_display_only(c: Column, site_host: Column) -> Column:
    """Another host, three segments or more, or a segment that begins with a year and a dash."""
    s = path_segments(c)
    return is_absolute(c) & ((host(c) != F.lower(F.coalesce(site_host, F.lit("")))) | (F.size(s) >= 3) | F.exists(s, lambda x: x.rlike("^[0-9]{4}-")))


def is_start_page_alias(c: Column, start: Column) -> Column:
    p = F.lower(F.regexp_replace(normalize_path(path(c)), "^/+", ""))
    return is_absolute(c) & is_absolute(start) & (host(c) == host(start)) & p.isin(*vocab.START_ALIASES)


def path_shape(c: Column) -> Column:
    """The path with ids, years and deep slugs replaced by what they are."""
    shaped = F.transform(
        path_segments(c),
        lambda s, i: F.when(F.lower(s).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit("{guid}"))
        .when(s.rlike("^[0-9]{4}$"), F.lit("{year}"))
        .when(s.rlike("^[0-9]+$"), F.lit("{id}"))
        .when((i >= 2) & s.rlike("^[a-z0-9][a-z0-9-]{4,}$"), F.lit("{slug}"))
        .otherwise(s),
    )
    return F.concat(F.lit("/"), F.array_join(shaped, "/"))
