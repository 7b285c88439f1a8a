"""Rules that tell what a page is: content system, content type, utility pages, kinds of top-level sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text, urls, vocab


def detect_cms(html: Column) -> Column:
    """struct(kind, confidence, signals): the first system of the rule table with enough signs in the page."""
    low, tag = F.lower(F.coalesce(html, F.lit(""))), text.generator(F.coalesce(html, F.lit("")))
    out = F.struct(F.lit("Unknown").alias("kind"), F.lit("low").alias("confidence"), F.array().cast("array<string>").alias("signals"))
    for kind, signs, in_tag, needed, high in reversed(vocab.CMS_RULES):
        found = [F.when(low.contains(s), F.lit(s)) for s in signs]
        if in_tag:
            found.append(F.when(tag.contains(in_tag), F.lit(f"generator:{in_tag}")))
        signals = F.array_compact(F.array(*found))
        own = F.struct(F.lit(kind).alias("kind"), F.when(F.size(signals) >= high, "high").otherwise("medium").alias("confidence"), signals.alias("signals"))
        out = F.when(F.size(signals) >= needed, own).otherwise(out)
    return out


def cms_mismatch(expected: Column, found: Column) -> Column:
    return (F.coalesce(expected, F.lit("")) != "") & (F.lower(expected) != F.lower(F.coalesce(found, F.lit(""))))


SIGNS = ("search_in_main", "contact_form", "time_event", "pdf_links", "list_items", "news_class", "event_class", "archive_class", "doc_class", "contact_class", "list_class")


def content_type(path: Column, heading: Column, signs: dict[str, Column] | None = None) -> Column:
    """struct(content_type, confidence, path_signals, heading_signals). signs: structural signs of the main part, false where not given."""
    s = {k: F.lit(False) for k in SIGNS} | (signs or {})
    p, h = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(heading, F.lit("")))
    u = {k: text.contains_any(p, v) for k, v in vocab.CONTENT_PATH.items()}
    t = {k: text.contains_any(h, v) for k, v in vocab.CONTENT_HEADING.items()}
    listed = lambda flags: F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))
    grade = lambda high: F.when(high, "high").otherwise("medium")
    rules = (
        ("document", s["pdf_links"] | u["doc"] | t["doc"], grade(s["pdf_links"] | (u["doc"] & t["doc"]))),
        ("search", s["search_in_main"] | u["search"] | t["search"], grade(s["search_in_main"] & (u["search"] | t["search"]))),
        ("event", u["event"] | t["event"] | (s["time_event"] & s["event_class"]), grade(u["event"] | t["event"])),
        ("news", (u["news"] & ~u["archive"]) | (t["news"] & ~t["archive"]) | (s["time_event"] & s["news_class"] & ~s["event_class"] & ~u["archive"]), grade(u["news"] | t["news"])),
        ("archive", u["archive"] | t["archive"], F.lit("high")),
        ("contact", u["contact"] | t["contact"] | (s["contact_form"] & s["contact_class"]), grade(u["contact"] | t["contact"])),
        ("listing", u["listing"] & s["list_items"], F.lit("medium")),
    )
    kind, confidence = F.lit("normal_page"), F.lit("high")
    for name, rule, conf in reversed(rules):
        kind, confidence = F.when(rule, name).otherwise(kind), F.when(rule, conf).otherwise(confidence)
    return F.struct(kind.alias("content_type"), confidence.alias("confidence"), listed(u).alias("path_signals"), listed(t).alias("heading_signals"))


# ---- sections -----------------------------------------------------------------------------------------------------


def folded_path(url: Column) -> Column:
    return text.fold_text(F.translate(F.when(urls.is_absolute(url), urls.path(url)).otherwise(F.coalesce(url, F.lit(""))), "-_", "  "))


def folded(url: Column, title: Column) -> Column:
    return F.concat(text.fold_text(title), F.lit(" "), folded_path(url))


def _first_segment(url: Column) -> Column:
    return text.fold_text(F.coalesce(F.try_element_at(urls.path_segments(url), F.lit(1)), F.lit("")))


# The rules proper, over the folded text f, the folded first path segment and the number of segments.


def _utility(f: Column) -> Column:
    return text.contains_any(f, vocab.UTILITY_TOKENS)


def _error(f: Column) -> Column:
    return text.contains_any(f, vocab.ERROR_TOKENS)


def _micro(f: Column, first: Column, n: Column) -> Column:
    ending = reduce(lambda a, b: a | b, (first.endswith(e) for e in vocab.MICROSITE_ENDINGS))
    return text.contains_any(f, vocab.MICROSITE_TOKENS) | ((n == 1) & ending)


def _news(f: Column, first: Column) -> Column:
    dated = f.rlike(r"\b20[0-9]{2}\b") & ~f.contains(vocab.NOTICEBOARD)
    return text.contains_any(first, vocab.NEWS_ROOT_TOKENS) | (first == "anslag") | dated | text.contains_any(f, vocab.NEWS_TITLE_TOKENS)


def _topic(f: Column, n: Column) -> Column:
    score = F.when(n <= 1, 0.12).otherwise(-0.10)
    for tokens in vocab.TOPICS.values():
        hits = reduce(lambda a, b: a + b, (f.contains(t).cast("int") for t in tokens))
        score = score + F.when(hits >= 2, vocab.TOPIC_MORE).when(hits == 1, vocab.TOPIC_ONE).otherwise(0.0)
    return text.clamp01(score)


def _let(fields: dict[str, Column], body) -> Column:
    """body over a struct of fields, each of which is worked out once, however often body refers to it."""
    return F.transform(F.array(F.struct(*(c.alias(k) for k, c in fields.items()))), body)[0]


def is_utility_page(url: Column, title: Column) -> Column:
    return _let({"f": folded(url, title)}, lambda z: _utility(z["f"]))


def is_error_root(url: Column, title: Column) -> Column:
    return _let({"f": folded(url, title)}, lambda z: _error(z["f"]))


def is_microsite(url: Column, title: Column) -> Column:
    return _let({"f": folded(url, title), "first": _first_segment(url), "n": urls.path_segment_count(url)}, lambda z: _micro(z["f"], z["first"], z["n"]))


def is_news_root(url: Column, title: Column) -> Column:
    return _let({"f": folded(url, title), "first": _first_segment(url)}, lambda z: _news(z["f"], z["first"]))


def is_noticeboard(url: Column, title: Column) -> Column:
    return folded(url, title).contains(vocab.NOTICEBOARD)


def topic_score(url: Column, title: Column) -> Column:
    """How much a page looks like a top-level section, 0 to 1: place in the tree and topics of its title and path."""
    return _let({"f": folded(url, title), "n": urls.path_segment_count(url)}, lambda z: _topic(z["f"], z["n"]))


def root_class(url: Column, title: Column, start: Column, flags: dict[str, Column] | None = None) -> Column:
    """struct(kind, eligible, confidence, reason) of a page below the root.

    flags: is_synthetic, is_utility, primary_nav, homepage_anchor, has_children; false where not given.
    """
    g = {k: F.lit(False) for k in ("is_synthetic", "is_utility", "primary_nav", "homepage_anchor", "has_children")} | (flags or {})
    own = {"f": folded(url, title), "first": _first_segment(url), "n": urls.path_segment_count(url), "alias": urls.is_start_page_alias(url, start)} | g
    parts = lambda z: F.struct(*(z[k].alias(k) for k in ("f", "alias", *g)), _topic(z["f"], z["n"]).alias("score"), _micro(z["f"], z["first"], z["n"]).alias("micro"), _news(z["f"], z["first"]).alias("news"), z["f"].contains(vocab.NOTICEBOARD).alias("notice"))
    return F.transform(F.transform(F.array(F.struct(*(c.alias(k) for k, c in own.items()))), parts), _root_class)[0]


def _root_class(z: Column) -> Column:
    score, notice = z["score"], z["notice"]
    structural = z["primary_nav"] | z["homepage_anchor"] | z["has_children"]
    module = ~notice & z["homepage_anchor"] & ~z["primary_nav"] & ((score < vocab.ROOT_THRESHOLD) | z["news"] | z["micro"])
    total = score + F.when(notice, 0.45).otherwise(0.0) + F.when(z["primary_nav"], 0.25).otherwise(0.0) + F.when(z["homepage_anchor"], 0.20).otherwise(0.0) + F.when(z["has_children"], 0.10).otherwise(0.0)
    rules = (
        (z["alias"], "HomepageModuleRoot", F.lit(1.0), "homepage_alias_root"),
        (z["is_synthetic"], "DiscoveredOtherRoot", F.lit(0.85), "synthetic_helper_or_discovered_bucket"),
        (_utility(z["f"]) | z["is_utility"], "UtilityRoot", F.lit(0.95), "utility_or_meta_page"),
        (_error(z["f"]), "ErrorOrSystemRoot", F.lit(0.98), "error_or_system_root"),
        (z["micro"], "MicrositeRoot", F.lit(0.95), "microsite_or_special_purpose_portal"),
        (z["news"], "NewsOrEventRoot", F.lit(0.92), "news_event_service_or_notice_root"),
        (notice & ~structural, "UtilityRoot", F.lit(0.86), "noticeboard_without_structural_root_evidence"),
        (module, "HomepageModuleRoot", F.lit(0.84), "homepage_module_or_promo_root"),
        (total >= vocab.ROOT_THRESHOLD, "EligibleStructuralRoot", text.clamp01(total), "official_municipal_ia_section"),
    )
    out = F.struct(F.lit("DiscoveredOtherRoot").alias("kind"), F.lit(False).alias("eligible"), F.lit(0.72).alias("confidence"), F.lit("not_enough_municipal_ia_evidence").alias("reason"))
    for rule, kind, confidence, reason in reversed(rules):
        out = F.when(rule, F.struct(F.lit(kind).alias("kind"), F.lit(kind == "EligibleStructuralRoot").alias("eligible"), confidence.alias("confidence"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def viewer_bucket(kind: Column, is_utility: Column) -> Column:
    """Where a root page is listed: structural unless its class, or its flag, says otherwise."""
    return F.when(is_utility | kind.isin("UtilityRoot", "ErrorOrSystemRoot"), "utility").when(kind.isin("NewsOrEventRoot", "MicrositeRoot", "DiscoveredOtherRoot"), "discovered").otherwise("structural")


def evidence(df: DataFrame, weights, conditions: dict[str, Column], threshold: float, name: str, cap: Column | None = None, extra: Column | None = None) -> DataFrame:
    """df with <name>_confidence (0 to 1), <name>_accepted, <name>_positive, <name>_negative: the sum of weights of what holds and what doesn't."""
    total = F.lit(0.0)
    for key, yes, no in weights:
        total = total + F.when(conditions[key], yes).otherwise(no)
    if extra is not None:
        total = total + extra
    score = text.clamp01(total)
    if cap is not None:
        score = F.least(score, cap)
    positive = F.array_compact(F.array(*(F.when(conditions[k], F.lit(k)) for k, _, _ in weights)))
    negative = F.array_compact(F.array(*(F.when(~conditions[k], F.lit(k)) for k, _, no in weights if no)))
    return df.withColumn(f"{name}_confidence", score).withColumn(f"{name}_accepted", F.col(f"{name}_confidence") >= threshold).withColumn(f"{name}_positive", positive).withColumn(f"{name}_negative", negative)


def score_homepage_anchors(anchors: DataFrame) -> DataFrame:
    """anchors: url, title, site_host and the features in_main, in_card, visible, n_siblings of each link of a start page."""
    u, t = F.col("url"), F.col("title")
    one, article = urls.path_segment_count(u) == 1, urls.is_dated_or_article_url(u)
    n = F.length(F.trim(t))
    conditions = {
        "same_host": urls.same_site_host(urls.host(u), F.col("site_host")), "in_main": F.col("in_main"), "in_card": F.col("in_card"), "one_segment": one, "good_title": (n >= 3) & (n <= 120),
        "siblings": F.col("n_siblings") >= 3, "not_utility": ~is_utility_page(u, t), "not_article": ~article, "not_binary": ~urls.is_binary_asset(u), "visible": F.col("visible"),
    }
    return evidence(anchors, vocab.HOMEPAGE_WEIGHTS, conditions, vocab.HOMEPAGE_THRESHOLD, "homepage", cap=F.when(one & ~article, 1.0).otherwise(vocab.HOMEPAGE_CAP))
