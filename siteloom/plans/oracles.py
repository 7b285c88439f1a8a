"""SQL for the registered queries, for DuckDB over the same tables; written from the rules, not from the Spark code."""

from __future__ import annotations

from siteloom.functions import vocab


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


#: Pages with the parts of their addresses; all are absolute http(s) addresses without a port.
U = r"""
u AS (
  SELECT *, scheme || '://' || host AS site, regexp_replace(scheme || '://' || host || path, '/+$', '') AS canonical,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS segs
  FROM (SELECT page_id, url, html, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
               CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS path,
               regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS query,
               trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS title
        FROM pages)
), v AS (
  SELECT *, len(segs) AS n, CASE WHEN len(segs) >= 2 THEN site || '/' || array_to_string(segs[:-2], '/') END AS prefix, CASE WHEN len(segs) > 0 THEN segs[-1] ELSE '' END AS last,
         strip_accents(lower(title)) || ' ' || strip_accents(lower(translate(path, '-_', '  '))) AS folded, strip_accents(lower(CASE WHEN len(segs) > 0 THEN segs[1] ELSE '' END)) AS first
  FROM u
)"""

#: Folding also turns dashes and bars; done where it is used.
FOLDED = "replace(replace(replace(folded, '–', '-'), '—', '-'), '|', ' ')"
ARTICLE = f"(regexp_matches(lower(path), '/20[0-9]{{2}}([-/][0-9]{{2}})?([-/][0-9]{{2}})?(/|$)') OR {_has('lower(path)', vocab.ARTICLE_TOKENS)})"
UTILITY = _has(FOLDED, vocab.UTILITY_TOKENS)
BINARY = r"regexp_matches(lower(path), '[.](" + "|".join(vocab.BINARY_EXTENSIONS) + ")$')"
SLUG = "upper(substr(replace({0}, '-', ' '), 1, 1)) || substr(replace({0}, '-', ' '), 2)"
SECTION = r"regexp_replace(regexp_replace(CASE WHEN length(regexp_replace(path, '/+', '/', 'g')) > 1 THEN regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') ELSE '/' END, '(?i)[.]html$', ''), '^(.+)[.][0-9]+$', '\1')"

ANCHORS = r"""
a AS (
  SELECT page_id, url AS page_url, i - 1 AS pos, h[i] AS href,
         trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t[i], '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, url, h, t, unnest(range(1, len(h) + 1)) AS i
        FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h,
                     regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS t FROM pages))
), c AS (
  SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY page_id, lower(target), reason IS NULL ORDER BY pos) > 1 THEN 'duplicate' ELSE reason END AS why
  FROM (SELECT page_id, page_url, pos, href, regexp_replace(regexp_extract(lower(page_url), '^(https?://[^/?#]+)', 1) || regexp_extract(href, '^([^?#]*)', 1), '/+$', '') AS target,
               CASE WHEN trim(href) = '' THEN 'empty_href' WHEN href[1] = '#' THEN 'hash_link' WHEN regexp_matches(lower(href), '^javascript:') THEN 'javascript_link' WHEN regexp_matches(lower(href), '^mailto:') THEN 'mailto'
                    WHEN regexp_matches(lower(href), '^tel:') THEN 'tel' WHEN regexp_matches(lower(href), '[.](__BINARY__)$') THEN 'binary_asset' END AS reason FROM a)
)""".replace("__BINARY__", "|".join(vocab.BINARY_EXTENSIONS))


def _weights(weights, conditions: dict[str, str]) -> str:
    return " + ".join(f"CASE WHEN {conditions[k]} THEN {yes}e0 ELSE {no}e0 END" for k, yes, no in weights)


def _clamped(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


TOPIC = _clamped(
    "CASE WHEN n <= 1 THEN 0.12e0 ELSE -0.10e0 END"
    + "".join(
        f" + CASE WHEN {h} >= 2 THEN {vocab.TOPIC_MORE}e0 WHEN {h} = 1 THEN {vocab.TOPIC_ONE}e0 ELSE 0e0 END"
        for h in ("(" + " + ".join(f"contains({FOLDED}, '{t}')::int" for t in ts) + ")" for ts in vocab.TOPICS.values())
    )
)
MICRO = f"({_has(FOLDED, vocab.MICROSITE_TOKENS)} OR (n = 1 AND ({' OR '.join(f'ends_with(first, {chr(39)}{e}{chr(39)})' for e in vocab.MICROSITE_ENDINGS)})))"
NEWS = rf"({_has('first', vocab.NEWS_ROOT_TOKENS)} OR first = 'anslag' OR (regexp_matches({FOLDED}, '\b20[0-9]{{2}}\b') AND NOT contains({FOLDED}, '{vocab.NOTICEBOARD}')) OR {_has(FOLDED, vocab.NEWS_TITLE_TOKENS)})"

#: Known pages: all, and the sections one level up.
KNOWN = "k AS (SELECT site, lower(canonical) AS key, min_by(canonical, page_id) AS known FROM (SELECT site, canonical, page_id FROM v UNION ALL SELECT site, prefix, page_id FROM v) WHERE canonical IS NOT NULL GROUP BY 1, 2)"
#: All proper prefixes of a page's path, the nearest first.
ANCESTOR = f"""{KNOWN}, up AS (
  SELECT v.page_id, v.site, i, site || '/' || array_to_string(segs[:i], '/') AS prefix FROM v, unnest(range(1, n)) AS r(i)
), near AS (SELECT page_id, max_by(known, i) AS ancestor FROM up JOIN k ON k.site = up.site AND k.key = lower(up.prefix) GROUP BY page_id)"""

HALVES = "h AS (SELECT user_id, event_type AS metric, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS previous, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS current FROM events GROUP BY 1, 2)"
RULES = "r(metric, low, share) AS (VALUES ('view', true, 0.10e0), ('click', true, 0.20e0), ('purchase', true, 0.15e0), ('error', false, 0.20e0), ('signup', false, 0.30e0))"
DELTAS = f"""{HALVES}, {RULES}, d AS (
  SELECT user_id, metric, previous, current, current - previous AS delta,
         CASE WHEN (CASE WHEN low THEN current < previous ELSE current > previous END) AND (CASE WHEN previous > 0 THEN abs(current - previous)::double / previous ELSE 0 END) >= share THEN 'regressed'
              WHEN (CASE WHEN low THEN current > previous ELSE current < previous AND previous > 0 END) THEN 'improved' ELSE 'unchanged' END AS verdict
  FROM h JOIN r USING (metric))"""
LISTS = f"""{DELTAS}, m AS (SELECT user_id, coalesce(list_sort(list(metric) FILTER (verdict = 'regressed')), []) AS regressed, coalesce(list_sort(list(metric) FILTER (verdict = 'improved')), []) AS improved FROM d GROUP BY 1)"""
EVENT_K = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
NOVEL = f"""{EVENT_K}, w AS (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 OR (k IS NOT NULL AND row_number() OVER (PARTITION BY user_id, k % 10 ORDER BY event_id) = 1) AS is_new,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM e)"""

#: Candidates for missing sections and their scores.
SYNTHETIC = f"""g AS (SELECT site, prefix, count(*) AS n_children, {SLUG.format("regexp_extract(min(prefix), '([^/]*)$', 1)")} AS title, regexp_extract(prefix, '([^/]*)$', 1) AS slug, regexp_extract(prefix, '^https?://[^/]+(.*)$', 1) AS path
        FROM v WHERE prefix IS NOT NULL GROUP BY site, prefix),
s AS (SELECT g.*, strip_accents(lower(title)) || ' ' || strip_accents(lower(translate(path, '-_', '  '))) AS folded, EXISTS (SELECT 1 FROM v WHERE v.site = g.site AND lower(v.canonical) = lower(g.prefix)) AS known FROM g),
sc AS (SELECT *, {_clamped(_weights(vocab.SYNTHETIC_WEIGHTS, {"prefix_unknown": "NOT known", "two_children": "n_children >= 2", "referenced": "false", "not_dated": f"NOT {ARTICLE}", "not_binary": f"NOT {BINARY}", "not_utility": f"NOT {UTILITY}", "no_cycle": "true", "shallow": "len(string_split(path, '/')) - 1 <= 4", "ancestor_known": "false", "deep_root_children": "true"}) + " + CASE WHEN regexp_matches(slug, '^([0-9]*|[0-9]{4}(-[0-9]{2}){0,2})$') THEN " + str(vocab.SLUG_PENALTY) + "e0 ELSE 0e0 END")} AS score FROM s)"""
TREE = f"""{SYNTHETIC}, ok AS (SELECT * FROM sc WHERE score >= {vocab.SYNTHETIC_THRESHOLD}e0),
top AS (SELECT site, max(page_id) AS last FROM v GROUP BY site),
made AS (SELECT ok.site, prefix AS url, site AS parent, true AS synthetic, last + row_number() OVER (PARTITION BY ok.site ORDER BY lower(prefix)) AS ord FROM ok JOIN top USING (site)),
it AS (SELECT v.site, canonical AS url, coalesce(ok.prefix, v.site) AS parent, false AS synthetic, page_id AS ord FROM v LEFT JOIN ok ON ok.site = v.site AND ok.prefix = v.prefix UNION ALL SELECT site, url, parent, synthetic, ord FROM made)"""

#: Sections as homepage links; what hangs below which, and what becomes of the root pages.
CANDIDATES = "cand AS (SELECT site, min(prefix) AS url, min(page_id) AS ord, regexp_extract(min(prefix), '([^/]*)$', 1) <> 'en' AS accepted FROM v WHERE prefix IS NOT NULL GROUP BY site, prefix)"
VISIBLE = f"""{CANDIDATES}, y AS (SELECT DISTINCT site, lower(url) AS k, accepted FROM cand),
t AS (SELECT it.site, it.url, it.parent, false AS is_start, it.parent = it.site AS is_root, coalesce(a.accepted, false) AS yes, coalesce(b.accepted, false) AS yes_parent, a.accepted IS NOT NULL AND NOT a.accepted AS no
      FROM it LEFT JOIN y a ON a.site = it.site AND a.k = lower(it.url) LEFT JOIN y b ON b.site = it.site AND b.k = lower(it.parent) UNION ALL SELECT DISTINCT site, site, '', true, false, false, false, false FROM v),
r AS (SELECT site, (SELECT count(*) FROM y WHERE y.site = t.site AND accepted) AS accepted, count(*) FILTER (is_root AND yes) AS overlap, count(*) FILTER (is_root) AS before, count(*) FILTER (is_root AND NOT yes) AS suppressed,
      count(*) FILTER (is_root AND no) AS rejected, count(*) FILTER (NOT is_start AND NOT is_root AND NOT yes_parent) AS lost, count(*) AS flat FROM t GROUP BY site),
r1 AS (SELECT *, CASE WHEN accepted = 0 THEN 'no_accepted_homepage_anchors' WHEN accepted < 2 AND before >= 3 THEN 'sparse_homepage_anchors' WHEN overlap = 0 AND before > 0 THEN 'homepage_anchors_do_not_overlap_primary_roots'
      WHEN before >= 4 AND overlap > 0 AND overlap < least(2, accepted) THEN 'homepage_anchors_low_overlap_with_primary_roots' ELSE '' END AS early FROM r),
r2 AS (SELECT site, accepted, overlap, before AS roots_before, CASE WHEN early <> '' THEN before ELSE overlap END AS roots_after, suppressed, rejected AS rejected_suppressed, CASE WHEN early <> '' THEN 0 ELSE lost END AS orphaned,
      CASE WHEN early <> '' THEN early WHEN overlap = 0 THEN 'suppression_would_empty_navigation' WHEN before >= 3 AND overlap < greatest(2, before // 2) THEN 'suppression_would_collapse_visible_roots'
           WHEN lost >= 25 AND lost > greatest(overlap * 5, flat // 10) THEN 'suppression_would_massively_orphan_descendants' ELSE '' END AS reason FROM r1)"""
# Words of addresses that have lost their marks don't occur in the tables; a test has them.
WORDS = "coalesce(upper(substr(w, 1, 1)) || substr(w, 2), url)"

GENERATOR = """lower(coalesce(nullif(regexp_extract(html, '(?is)<meta\\s[^>]*name=["'']generator["''][^>]*content=["'']([^"'']+)["'']', 1), ''), regexp_extract(html, '(?is)<meta\\s[^>]*content=["'']([^"'']+)["''][^>]*name=["'']generator["'']', 1)))"""


def _cms() -> str:
    counts, kind, grade, number = [], "'Unknown'", "'low'", "0"
    for i, (name, signs, tag, needed, high) in enumerate(vocab.CMS_RULES):
        terms = [f"contains(low, '{s}')::int" for s in signs] + ([f"contains(gen, '{tag}')::int"] if tag else [])
        counts.append("(" + " + ".join(terms) + f") AS c{i}")
    for i, (name, signs, tag, needed, high) in reversed(list(enumerate(vocab.CMS_RULES))):
        kind, grade, number = (f"CASE WHEN c{i} >= {needed} THEN {x} ELSE {y} END" for x, y in ((f"'{name}'", kind), (f"CASE WHEN c{i} >= {high} THEN 'high' ELSE 'medium' END", grade), (f"c{i}", number)))
    return f"SELECT page_id, {kind} AS cms, {grade} AS confidence, {number} AS n_signals FROM (SELECT page_id, {', '.join(counts)} FROM (SELECT page_id, lower(html) AS low, {GENERATOR} AS gen FROM pages))"


def _content(heading: str) -> tuple[str, str]:
    p = {k: _has("lower(path)", v) for k, v in vocab.CONTENT_PATH.items()}
    t = {k: _has(f"lower({heading})", v) for k, v in vocab.CONTENT_HEADING.items()}
    kind = f"CASE WHEN {p['doc']} OR {t['doc']} THEN 'document' WHEN {p['search']} OR {t['search']} THEN 'search' WHEN {p['event']} OR {t['event']} THEN 'event' WHEN ({p['news']} AND NOT {p['archive']}) OR ({t['news']} AND NOT {t['archive']}) THEN 'news' WHEN {p['archive']} OR {t['archive']} THEN 'archive' WHEN {p['contact']} OR {t['contact']} THEN 'contact' ELSE 'normal_page' END"
    grade = f"CASE WHEN {p['doc']} OR {t['doc']} THEN CASE WHEN {p['doc']} AND {t['doc']} THEN 'high' ELSE 'medium' END WHEN {p['search']} OR {t['search']} THEN 'medium' ELSE 'high' END"
    return kind, grade


SHAPE = r"""'/' || array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN regexp_matches(lower(segs[i]), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN '{guid}' WHEN regexp_matches(segs[i], '^[0-9]{4}$') THEN '{year}'
  WHEN regexp_matches(segs[i], '^[0-9]+$') THEN '{id}' WHEN i >= 3 AND regexp_matches(segs[i], '^[a-z0-9][a-z0-9-]{4,}$') THEN '{slug}' ELSE segs[i] END), '/')"""
RAW = "(trim({0}) = '' OR regexp_matches(lower(trim({0})), '^(https?://|/)') OR lower(trim({0})) = lower(url){1})"


def oracle_sql() -> dict[str, str]:
    kind, grade = _content("title")
    h1 = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"
    fkind, _ = _content("heading")
    fkind = fkind.replace("CASE WHEN", "CASE WHEN regexp_matches(html, '(?i)href=[\"''][^\"'']*[.]pdf') OR", 1)
    tag = lambda t: f"len(regexp_extract_all(html, '(?i)<{t}[\\s>]'))"
    root_kind = f"""CASE WHEN {UTILITY} THEN 'UtilityRoot' WHEN {_has(FOLDED, vocab.ERROR_TOKENS)} THEN 'ErrorOrSystemRoot' WHEN {MICRO} THEN 'MicrositeRoot' WHEN {NEWS} THEN 'NewsOrEventRoot'
      WHEN contains({FOLDED}, '{vocab.NOTICEBOARD}') AND page_id % 2 <> 0 AND page_id % 3 <> 0 THEN 'Notice' WHEN total >= {vocab.ROOT_THRESHOLD}e0 THEN 'EligibleStructuralRoot' ELSE 'DiscoveredOtherRoot' END"""
    title_or_url = "CASE WHEN page_id % 2 = 0 THEN title ELSE url END"
    raw = RAW.format("t", " OR lower(trim(t)) = host OR 'www.' || lower(trim(t)) = host")
    parent_conditions = {
        "ancestor_found": "ancestor IS NOT NULL", "descends": "ancestor IS NOT NULL", "not_root": "ancestor IS NOT NULL", "structural": "page_id % 2 = 0", "parent_not_article": "ancestor IS NOT NULL AND NOT parent_article",
        "no_cycle": "ancestor IS NOT NULL", "two_segments": "n >= 2", "child_not_utility": f"NOT {UTILITY}",
    }
    parent_score = _clamped(_weights(vocab.PARENT_WEIGHTS, parent_conditions))
    return {
        "url_normalize": f"WITH {U} SELECT page_id, canonical AS no_query, regexp_replace(scheme || '://' || host || path || query, '/+$', '') AS with_query, CASE WHEN url LIKE 'http://%' THEN url ELSE 'https://' || substr(url, 9) END AS with_scheme FROM v",
        "url_canonical_key": f"WITH {U} SELECT page_id, lower(canonical) AS url_key, upper(substr(b, 1, 1)) || substr(b, 2) AS site_name FROM (SELECT *, string_split(regexp_replace(host, '^www[.]', ''), '.')[1] AS b FROM v)",
        "url_segments": f"WITH {U} SELECT page_id, n AS n_segments, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS last_segment, prefix AS prefix_url, {SECTION} AS section FROM v",
        "url_path_shape": f"WITH {U} SELECT page_id, {SHAPE} AS shape FROM v",
        "page_file_key": f"WITH {U} SELECT page_id, 'p_' || sha1(canonical) AS file_key FROM v",
        "url_predicates": f"""WITH {U} SELECT page_id, true AS http, {BINARY} AS binary, {_has("lower(path)", vocab.NOISE_INSIDE)} OR ends_with(lower(path), '/rss') AS noise, {ARTICLE} AS article,
            host <> regexp_replace(host, '^(www|m|blog)[.]', '') OR n >= 3 OR len(list_filter(segs, lambda x: regexp_matches(x, '^[0-9]{{4}}-'))) > 0 AS display_only,
            regexp_matches(regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1), '^([0-9]*|[0-9]{{4}}(-[0-9]{{2}}){{0,2}})$') AS numeric_slug, lower(trim(path, '/')) IN ({_list(vocab.START_ALIASES)}) AS start_alias FROM v""",
        "same_site_host": f"WITH {U} SELECT page_id, regexp_replace(host, '^www[.]', '') = bare AS same_site, regexp_replace(host, '^www[.]', '') = bare AND starts_with(lower(path), '/en/') AND length(trim(path, '/')) > 2 AS below_en FROM (SELECT *, regexp_replace(host, '^(www|m)[.]', '') AS bare FROM v)",
        "page_title": f"WITH {U} SELECT page_id, title FROM v",
        "display_title": f"""WITH {U} SELECT page_id, CASE WHEN NOT {raw} THEN trim(t) ELSE {SLUG.format("last")} END AS display, CASE WHEN NOT {raw} THEN 'trusted_title' ELSE 'humanized_slug' END AS reason, {SLUG.format("last")} AS slug_title
            FROM (SELECT *, {title_or_url} AS t FROM v)""",
        "anchor_extract": f"WITH {ANCHORS} SELECT page_id, pos, href, text FROM a",
        "link_classify": f"WITH {ANCHORS} SELECT page_id, pos, CASE WHEN why IS NULL OR why = 'duplicate' THEN target END AS url, why AS reason FROM c",
        "link_reject_histogram": f"WITH {ANCHORS} SELECT why AS reason, count(*) AS n FROM c WHERE why IS NOT NULL GROUP BY 1",
        "cms_detect": _cms(),
        "content_type": f"WITH {U} SELECT page_id, {kind} AS content_type, {grade} AS confidence FROM v",
        "template_fingerprint": f"""WITH {U}, f AS (SELECT *, {h1} AS heading, {SHAPE} AS path_shape, 'h1:' || {tag('h1')} || ',h2:' || {tag('h2')} || ',h3:' || {tag('h3')} AS heading_shape,
              CASE WHEN regexp_matches(html, '<main[\\s>]') THEN len(regexp_extract_all(regexp_extract(html, '(?is)<main[\\s>](.*)', 1), '<(section|article)[\\s>]')) ELSE 0 END AS k FROM v),
            g AS (SELECT *, {fkind} AS content_type, CASE WHEN k = 0 THEN 'none' WHEN k <= 3 THEN 'small' WHEN k <= 8 THEN 'medium' ELSE 'large' END AS section_bucket FROM f), cms AS ({_cms()})
            SELECT g.page_id, path_shape, content_type, heading_shape, section_bucket,
              upper(substr(sha256('classes=|cms=' || cms || '|contentType=' || content_type || '|hasBreadcrumb=' || regexp_matches(html, '(class|aria-label)="[^"]*[Bb]readcrumb|class="([^"]* )?crumbs[ "]')::int
                || '|hasHeaderNav=' || regexp_matches(html, '(?s)(<header[\\s>]|class="[^"]*header).*<nav[\\s>]|role="navigation"')::int || '|hasLocalNav=' || regexp_matches(html, '(?s)(<aside[\\s>]|class="[^"]*sidebar).*<nav[\\s>]|class="[^"]*(local-nav|left-nav|sidenav)')::int
                || '|hasMain=' || regexp_matches(html, '<main[\\s>]|role="main"')::int || '|headingShape=' || heading_shape || '|pathShape=' || path_shape || '|sectionBucket=' || section_bucket), 1, 16)) AS fingerprint FROM g JOIN cms USING (page_id)""",
        "root_class": f"""WITH {U}, t AS (SELECT *, {TOPIC} AS topic FROM v), s AS (SELECT *, topic + CASE WHEN contains({FOLDED}, '{vocab.NOTICEBOARD}') THEN 0.45e0 ELSE 0e0 END + CASE WHEN page_id % 3 = 0 THEN 0.25e0 ELSE 0e0 END + CASE WHEN page_id % 2 = 0 THEN 0.10e0 ELSE 0e0 END AS total FROM t),
            k AS (SELECT *, {root_kind} AS kind FROM s)
            SELECT page_id, CASE WHEN kind = 'Notice' THEN 'UtilityRoot' ELSE kind END AS kind, kind = 'EligibleStructuralRoot' AS eligible, round(topic, 6) AS topic_score,
              round(CASE kind WHEN 'UtilityRoot' THEN 0.95e0 WHEN 'ErrorOrSystemRoot' THEN 0.98e0 WHEN 'MicrositeRoot' THEN 0.95e0 WHEN 'NewsOrEventRoot' THEN 0.92e0 WHEN 'Notice' THEN 0.86e0 WHEN 'EligibleStructuralRoot' THEN {_clamped('total')} ELSE 0.72e0 END, 6) AS confidence FROM k""",
        "root_topology_by_site": f"""WITH {U}, t AS (SELECT site AS site_id, count(*) AS root_children, count(*) FILTER (n >= 2) AS deep, count(*) FILTER (NOT {UTILITY} AND n < 2) AS structural, count(*) FILTER ({UTILITY}) AS utility,
              count(*) FILTER (NOT {UTILITY} AND n >= 2) AS discovered, count(*) FILTER (n >= 2) AS deep_leaf, count(*) AS singleton, 0 AS synthetic, count(*) FILTER ({RAW.format('title', '').replace('lower(url)', 'lower(canonical)')}) AS raw_title FROM v WHERE canonical <> site GROUP BY site)
            SELECT *, CASE WHEN root_children > 50 OR deep > 20 OR raw_title > 0 THEN 'FAIL' WHEN deep > 0 OR utility > 5 OR discovered > 10 OR synthetic > 8 THEN 'PASS_WITH_MINOR_ISSUES' ELSE 'PASS' END AS verdict FROM t""",
        "duplicate_titles": f"WITH {U} SELECT site_id, count(*) AS n_groups FROM (SELECT site AS site_id, lower(title) AS k FROM v WHERE trim(title) <> '' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1",
        "duplicate_urls": f"WITH {U} SELECT site_id, count(*) AS n_groups FROM (SELECT site AS site_id, lower(prefix) AS k FROM v WHERE prefix IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1",
        "orphan_pages": f"WITH {U} SELECT site AS site_id, canonical AS url, prefix AS parent_url, page_id FROM v WHERE page_id % 3 <> 0 AND prefix IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v w WHERE w.site = v.site AND lower(w.canonical) = lower(v.prefix))",
        "nearest_ancestor": f"WITH {U}, {ANCESTOR} SELECT page_id, ancestor FROM v LEFT JOIN near USING (page_id)",
        "section_join": f"""WITH {U}, {KNOWN}, s AS (SELECT site, known, lower({SECTION}) AS sp FROM (SELECT site, known, substr(known, length(site) + 1) AS path FROM k)),
            m AS (SELECT page_id, arg_max(known, length(sp)) AS section FROM v JOIN s ON s.site = v.site AND sp NOT IN ('', '/') AND starts_with(lower(v.path), sp || '/') AND length(v.path) > length(sp) + 1 AND lower(known) <> lower(canonical) GROUP BY page_id)
            SELECT page_id, section FROM v LEFT JOIN m USING (page_id)""",
        "url_parent_score": f"WITH {U}, {ANCESTOR}, q AS (SELECT v.*, ancestor, {ARTICLE.replace('path', 'ancestor')} AS parent_article FROM v LEFT JOIN near USING (page_id)) SELECT page_id, round(score, 6) AS confidence, score >= {vocab.PARENT_THRESHOLD}e0 AS accepted FROM (SELECT page_id, {parent_score} AS score FROM q)",
        "synthetic_parents": f"WITH {U}, {SYNTHETIC} SELECT site AS site_id, prefix AS prefix_url, n_children, round(score, 6) AS confidence, score >= {vocab.SYNTHETIC_THRESHOLD}e0 AS accepted, title, site AS parent_url FROM sc",
        "depth_recalc": f"WITH {U}, {TREE} SELECT site AS site_id, url, parent AS parent_url, CASE WHEN parent = site THEN 1 ELSE 2 END AS depth, synthetic AS is_synthetic FROM it",
        "dedup_best_row": f"""WITH {U}, s AS (SELECT *, CASE WHEN trim(title) = '' THEN 0 WHEN lower(trim(title)) = lower(prefix) OR regexp_matches(lower(trim(title)), '^https?://') THEN 1 ELSE least(length(trim(title)), 200) END AS ts FROM v WHERE prefix IS NOT NULL),
            q AS (SELECT *, 1000 + CASE WHEN page_id % 3 > 0 THEN 200 ELSE -1000 END + least(100, ts) AS score FROM s)
            SELECT site AS site_id, prefix AS url, arg_max(title, ts * 1e15 + (score + 2000) * 1e9 - page_id) AS title, min(page_id) AS first_ord, bool_and(page_id % 2 = 0) AS is_display_only, (arg_max(page_id, (score + 2000) * 1e9 - page_id) % 3)::int AS depth FROM q GROUP BY site, prefix""",
        "tree_preorder": f"""WITH RECURSIVE {U}, {TREE}, no AS (SELECT site, lower(url) AS node, arg_min(url, ord) AS url, min(ord) AS ord, arg_min(lower(parent), ord) AS parent FROM it GROUP BY 1, 2),
            w(site, node, url, path) AS (SELECT no.site, no.node, no.url, [no.ord] FROM no WHERE NOT EXISTS (SELECT 1 FROM no p WHERE p.site = no.site AND p.node = no.parent)
              UNION ALL SELECT no.site, no.node, no.url, list_append(w.path, no.ord) FROM no JOIN w ON w.site = no.site AND w.node = no.parent)
            SELECT site AS site_id, row_number() OVER o - 1 AS pos, url, lag(url) OVER o AS prev_url, lead(url) OVER o AS next_url FROM w WINDOW o AS (PARTITION BY site ORDER BY path)""",
        "spread_sample": f"""WITH {ANCHORS}, i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY page_id) AS m FROM a),
            p AS (SELECT * FROM i WHERE m <= 4 OR i IN (round_even(0 * ((m - 1) / 3e0), 0), round_even(1 * ((m - 1) / 3e0), 0), round_even(2 * ((m - 1) / 3e0), 0), round_even(3 * ((m - 1) / 3e0), 0)))
            SELECT page_id, pos, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(href) ORDER BY i) AS k FROM p) WHERE m <= 4 OR k = 1""",
        "link_cap": f"WITH {ANCHORS} SELECT page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM a) WHERE k <= 3",
        "depth_cap": f"WITH {U} SELECT page_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY site, depth ORDER BY page_id) AS k FROM (SELECT page_id, site, (n + page_id % 2)::int AS depth FROM v)) WHERE k <= 3",
        "structural_links": f"""WITH {ANCHORS}, n AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, CASE WHEN trim(text) <> '' THEN trim(text) ELSE trim(href) END AS name FROM a),
            q AS (SELECT page_id, pos, name, href, least(0.999e0, 0.91e0 + 0.04e0 + CASE WHEN length(name) >= 6 THEN 0.02e0 ELSE 0e0 END + CASE WHEN length(name) >= 14 THEN 0.02e0 ELSE 0e0 END + CASE WHEN n >= 4 THEN 0.04e0 ELSE 0e0 END + CASE WHEN n >= 8 THEN 0.04e0 ELSE 0e0 END) AS score
                  FROM n WHERE trim(href) <> '' AND NOT regexp_matches(lower(href), '^(#|javascript:|mailto:|tel:)'))
            SELECT page_id, pos, name, 'nav' AS kind, round(score, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY score DESC, pos) AS k FROM q) WHERE k = 1""",
        "local_links": f"""WITH {ANCHORS}, q AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS k FROM a WHERE trim(href) <> '' AND NOT regexp_matches(lower(href), '^(#|javascript:|mailto:|tel:)'))
            SELECT page_id, pos, CASE WHEN text <> '' THEN text ELSE regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || href END AS name, 'nav' AS kind, 0.9e0 AS confidence, true AS is_structural, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM q WHERE k = 1""",
        "dom_links": f"""WITH {ANCHORS}, q AS (SELECT page_id, pos, href, greatest(0.05e0, least(0.999e0, 0.91e0 + CASE WHEN length(text) BETWEEN 3 AND 60 THEN 0.02e0 ELSE -0.05e0 END - CASE WHEN pos > 200 THEN 0.05e0 ELSE 0e0 END)) AS score FROM a)
            SELECT page_id, href AS url, 'nav' AS container, round(score, 6) AS confidence, true AS is_structural FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(href) ORDER BY score DESC, pos) AS k FROM q) WHERE k = 1""",
        "quality_warnings": f"""WITH {U}, {ANCHORS}, f AS (SELECT site, count(*) AS flat, count(*) FILTER (title = '') AS empty, max(n) AS depth, count(DISTINCT prefix) AS nodes, count(*) FILTER (n >= 2) AS deep, count(*) FILTER (canonical <> site) AS roots,
              count(*) FILTER (canonical <> site AND {UTILITY}) AS utility, count(*) FILTER (canonical <> site AND NOT {UTILITY} AND n >= 2) AS discovered, count(*) FILTER (canonical <> site AND {RAW.format('title', '').replace('lower(url)', 'lower(canonical)')}) AS raw,
              count(*) FILTER (prefix IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v w WHERE w.site = v.site AND lower(w.canonical) = lower(v.prefix))) AS orphans FROM v GROUP BY site),
            t AS (SELECT site, count(*) AS same FROM (SELECT site, lower(title) FROM v WHERE trim(title) <> '' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
            l AS (SELECT v.site, count(*) FILTER (why IS NULL) AS accepted, count(*) FILTER (why = 'external_host') AS outside, count(*) FILTER (why = 'binary_asset') AS files FROM c JOIN v USING (page_id) GROUP BY 1),
            m AS (SELECT f.*, coalesce(same, 0) AS same, round_even(coalesce(accepted, 0) / flat, 1) AS links, coalesce(outside, 0) AS outside, coalesce(files, 0) AS files FROM f LEFT JOIN t USING (site) LEFT JOIN l USING (site))
            SELECT site AS site_id, w.code AS code, w.severity AS severity FROM (SELECT site, unnest(list_filter([
              CASE WHEN nodes < 0.3 * flat THEN {{'code': 'tree_far_smaller_than_flat', 'severity': 'warning'}} END, CASE WHEN orphans / flat > 0.4 THEN {{'code': 'high_orphan_ratio', 'severity': 'warning'}} END,
              CASE WHEN same / flat > 0.15 THEN {{'code': 'high_duplicate_titles', 'severity': 'warning'}} END, CASE WHEN empty / flat > 0.1 THEN {{'code': 'high_empty_title_ratio', 'severity': 'warning'}} END,
              CASE WHEN roots > 50 THEN {{'code': 'root_child_explosion', 'severity': 'error'}} END, CASE WHEN deep > 20 THEN {{'code': 'root_leaf_pollution', 'severity': 'error'}} END,
              CASE WHEN deep BETWEEN 1 AND 20 THEN {{'code': 'root_child_path_depth_too_high', 'severity': 'warning'}} END, CASE WHEN raw > 0 THEN {{'code': 'raw_url_labels_at_root', 'severity': 'error'}} END,
              CASE WHEN utility > 5 THEN {{'code': 'utility_root_pollution', 'severity': 'warning'}} END, CASE WHEN discovered > 10 THEN {{'code': 'orphan_content_cluster', 'severity': 'warning'}} END,
              CASE WHEN depth = 1 THEN {{'code': 'low_max_depth', 'severity': 'warning'}} END, CASE WHEN links < 2 THEN {{'code': 'low_average_outlinks', 'severity': 'warning'}} END,
              CASE WHEN files > 50 THEN {{'code': 'many_binary_rejections', 'severity': 'info'}} END, CASE WHEN outside > 200 THEN {{'code': 'many_external_rejections', 'severity': 'info'}} END], lambda z: z IS NOT NULL)) AS w FROM m)""",
        "likely_sections": f"WITH {U} SELECT page_id, {TOPIC} >= 0.55e0 AND NOT {UTILITY} AND NOT {MICRO} AND NOT {NEWS} AND NOT {_has(FOLDED, vocab.ERROR_TOKENS)} AS likely FROM v",
        "link_attachment": f"""WITH {U}, {ANCHORS}, l AS (SELECT c.page_id, c.pos, v.canonical AS parent, v.site AS start, c.pos < 3 AS st, starts_with(lower(c.target), lower(v.canonical) || '/') AS below, lower(c.target) = lower(v.canonical) AS same, lower(v.canonical) = lower(v.site) AS at_start
              FROM c JOIN v ON v.page_id = c.page_id WHERE why IS NULL)
            SELECT page_id, pos, NOT same AND (st OR at_start OR below) AS attached, st OR (NOT at_start AND below) AS is_structural, CASE WHEN NOT at_start AND (st OR below) THEN parent ELSE start END AS parent, CASE WHEN at_start THEN false ELSE true END AS upgrades FROM l""",
        "accepted_ancestor": f"WITH {U}, {CANDIDATES}, m AS (SELECT v.page_id, arg_min(cand.url, cand.ord) AS accepted_ancestor FROM v JOIN cand ON cand.site = v.site AND accepted AND starts_with(lower(v.canonical), lower(cand.url) || '/') GROUP BY 1) SELECT page_id, accepted_ancestor FROM v LEFT JOIN m USING (page_id)",
        "visible_root_report": f"WITH {U}, {TREE}, {VISIBLE} SELECT site AS site_id, CASE WHEN reason = '' THEN 'applied' ELSE 'skipped' END AS status, reason, accepted, overlap, roots_before, roots_after, suppressed, rejected_suppressed, orphaned, CASE WHEN reason = '' THEN roots_before - overlap ELSE 0 END AS crawlable_not_visible FROM r2",
        "visible_tree": f"""WITH {U}, {TREE}, {VISIBLE} SELECT t.site AS site_id, url, parent AS parent_url FROM t JOIN r2 ON r2.site = t.site WHERE reason <> '' OR is_start OR yes OR yes_parent""",
        "page_files": f"""WITH {U}, p AS (SELECT site AS site_id, canonical AS url, 'pages/p_' || sha1(canonical) || '.htm' AS file, page_id, 0 AS kind FROM v UNION ALL SELECT site, replace(canonical, '://www.', '://'), 'pages/p_' || sha1(canonical) || '.htm', page_id, 1 FROM v WHERE host LIKE 'www.%')
            SELECT site_id, url, file FROM (SELECT *, row_number() OVER (PARTITION BY site_id, lower(url) ORDER BY page_id, kind) AS k FROM p) WHERE k = 1""",
        "ordered_children": f"WITH {U} SELECT page_id, row_number() OVER (PARTITION BY site, lower(prefix) ORDER BY lower(title), canonical, page_id) AS place FROM v WHERE prefix IS NOT NULL",
        "seed_subtrees": f"WITH {U}, {TREE} SELECT site AS site_id, min(url) AS url, CASE WHEN bool_or(lower(parent) = lower(site)) THEN 1 ELSE 2 END AS level FROM it GROUP BY site, lower(url) UNION ALL SELECT DISTINCT site, site, 0 FROM v",
        "slug_words": f"WITH {U} SELECT page_id, {WORDS} AS words FROM (SELECT *, replace(segs[-1], '-', ' ') AS w FROM v)",
        "event_counters": "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase' AND value > 5) AS purchases FROM events GROUP BY 1",
        "distinct_patterns": f"WITH {EVENT_K} SELECT user_id, count(DISTINCT event_type) AS n_types, count(DISTINCT k) AS n_k FROM e GROUP BY 1",
        "json_field_histogram": f"WITH {EVENT_K} SELECT k, count(*) AS n FROM e GROUP BY 1",
        "first_seen_top20": f"""WITH {EVENT_K}, g AS (SELECT event_type, event_type || ':' || k AS pattern, count(*) AS n, min(event_id) AS first_ord, arg_min(user_id, event_id) AS user_id FROM e WHERE k IS NOT NULL GROUP BY 1, 2)
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first_ord) AS rank FROM g) WHERE rank <= 20""",
        "saturation_by_user": f"WITH {NOVEL}, t AS (SELECT user_id, count(*) AS pages, count(*) FILTER (is_new) AS new_pages, count(*) FILTER (back <= 20 AND is_new) AS new_in_window FROM w GROUP BY 1) SELECT *, pages >= 20 AND new_in_window = 0 AS saturated FROM t",
        "stream_saturation": f"WITH {NOVEL}, t AS (SELECT user_id::varchar AS run_id, count(*) AS pages, count(*) FILTER (is_new) AS new_pages, count(*) FILTER (back <= 20 AND is_new) AS new_in_window FROM w GROUP BY 1) SELECT *, pages >= 20 AND new_in_window = 0 AS saturated FROM t",
        "until_saturated": f"""WITH {NOVEL}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sum(is_new::int) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING) AS new FROM w),
            z AS (SELECT user_id, min(n) FILTER (n >= 5 AND new = 0) AS stop FROM q GROUP BY 1) SELECT user_id, count(*) AS pages, max(event_id) AS last_event FROM q JOIN z USING (user_id) WHERE stop IS NULL OR n <= stop GROUP BY 1""",
        "report_changes": """WITH h AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS late FROM events), r AS (SELECT user_id, late, arg_min(event_type, event_id) AS cms, arg_max(event_type, event_id) AS grp FROM h GROUP BY 1, 2),
            p AS (SELECT user_id, event_type, min(event_id) FILTER (NOT late) % 3 AS a, min(event_id) FILTER (late) % 3 AS b FROM h GROUP BY 1, 2),
            m AS (SELECT user_id, count(*) FILTER (a <> b) AS changed_parents, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common FROM p GROUP BY 1)
            SELECT user_id, x.cms <> y.cms AS cms_changed, x.grp <> y.grp AS group_changed, changed_parents, common,
              array_to_string(list_filter([CASE WHEN x.cms <> y.cms THEN 'cms_changed' END, CASE WHEN x.grp <> y.grp THEN 'primary_group_changed' END, CASE WHEN changed_parents > greatest(10, common // 5) THEN 'parents_changed' END], lambda f: f IS NOT NULL), ',') AS reviews
            FROM r x JOIN r y USING (user_id) JOIN m USING (user_id) WHERE NOT x.late AND y.late""",
        "novelty_flags": f"WITH {NOVEL} SELECT event_id, is_new FROM w",
        "average_rounded": f"WITH {EVENT_K} SELECT event_type, round_even(avg(k), 1) AS average, arg_max(event_id, ts) AS last_event FROM e GROUP BY 1",
        "events_by_hour": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "run_metric_delta": f"WITH {DELTAS} SELECT * FROM d",
        "run_verdict": f"""WITH {LISTS} SELECT user_id, array_to_string(regressed, ',') AS regressed, array_to_string(improved, ',') AS improved,
            CASE WHEN len(regressed) > 0 AND len(improved) = 0 THEN 'regressed' WHEN len(improved) > 0 AND len(regressed) = 0 THEN 'improved' WHEN len(regressed) > 0 THEN 'review' ELSE 'unchanged' END AS verdict FROM m""",
        "urls_added_removed": f"""WITH {U}, p AS (SELECT site, lower(prefix) AS k, min(prefix) FILTER (page_id % 2 = 0) AS a, min(prefix) FILTER (page_id % 2 = 1) AS b FROM v WHERE prefix IS NOT NULL GROUP BY 1, 2)
            SELECT site AS site_id, coalesce(a, b) AS url, CASE WHEN a IS NULL THEN 'added' ELSE 'removed' END AS change FROM p WHERE a IS NULL OR b IS NULL""",
        "parent_changes": f"""WITH {U}, p AS (SELECT site, prefix AS url, 'p' || min(page_id) FILTER (page_id % 2 = 0) % 5 AS a, 'p' || min(page_id) FILTER (page_id % 2 = 1) % 5 AS b FROM v WHERE prefix IS NOT NULL GROUP BY 1, 2)
            SELECT site AS site_id, url, a AS old_parent, b AS new_parent FROM p WHERE a <> b""",
        "acceptance_decision": f"""WITH {LISTS}, x AS (SELECT user_id, ['smoke', 'cms-diagnostic', 'nav-diagnostic', 'snapshot-diagnostic', 'full-validation'][user_id % 5 + 1] AS profile, regressed AS g, improved AS i FROM m),
            y AS (SELECT *, profile = 'smoke' AS smoke, profile IN ('snapshot-diagnostic', 'full-validation') AS shots, profile = 'nav-diagnostic' AND user_id % 2 = 0 AND (list_contains(i, 'click')) AS excused FROM x),
            z AS (SELECT *, user_id % 11 = 0 OR user_id % 13 = 0 OR (NOT smoke AND list_contains(g, 'view') AND NOT excused) OR (NOT smoke AND list_contains(g, 'click')) OR (shots AND list_contains(g, 'purchase')) AS rej,
                  user_id % 7 = 0 OR (NOT smoke AND list_contains(g, 'view') AND excused) OR (NOT smoke AND list_contains(g, 'error')) OR (profile = 'full-validation' AND user_id % 2 <> 0) AS rev,
                  (len(i) > 0 AND len(g) = 0) OR (len(g) = 0 AND user_id % 3 = 0) OR smoke AS clean FROM y),
            d2 AS (SELECT user_id, CASE WHEN rej THEN 'rejected' WHEN rev THEN 'review' WHEN clean THEN 'accepted' ELSE 'review' END AS decision FROM z)
            SELECT user_id, decision, (CASE decision WHEN 'accepted' THEN 0 WHEN 'review' THEN 1 ELSE 2 END)::int AS exit_code FROM d2""",
    }
