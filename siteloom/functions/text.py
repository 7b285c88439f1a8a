"""Text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions import vocab


def fold_text(c: Column) -> Column:
    """Lower case without marks, long dashes as hyphens, bars as spaces. Marks of a closed alphabet and combining ones go."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[\\u0300-\\u036f]", "")
    return F.translate(F.translate(low, vocab.FOLD_FROM, vocab.FOLD_TO), "–—|", "-- ")


def contains_any(c: Column, tokens) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | c.contains(t)
    return out


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def html_escape(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_unescape(c: Column) -> Column:
    out = c
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _share(c: Column, chars: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, chars, ""))) / F.length(c)


def is_code_like(c: Column) -> Column:
    """Much punctuation in 120 characters or more, or few spaces in 200 or more."""
    t = F.coalesce(c, F.lit(""))
    return ((F.length(t) >= 120) & (_share(t, r"[{}();=<>\[\]]") > 0.05)) | ((F.length(t) >= 200) & (_share(t, " ") < 0.06))


def is_natural_text(c: Column) -> Column:
    """Three letters of five, and the end of a sentence at the end."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(t) > 0) & (_share(t, r"\p{L}") >= 0.6) & t.rlike("[.!?…]$")


def generator(html: Column) -> Column:
    """What the generator tag of a page says, lower-cased."""
    a = F.regexp_extract(html, r"""(?is)<meta\s[^>]*name=["']generator["'][^>]*content=["']([^"']+)["']""", 1)
    b = F.regexp_extract(html, r"""(?is)<meta\s[^>]*content=["']([^"']+)["'][^>]*name=["']generator["']""", 1)
    return F.lower(F.when(a != "", a).otherwise(b))


def page_title(html: Column) -> Column:
    return collapse_whitespace(html_unescape(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def meta_description(html: Column) -> Column:
    a = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<meta\s[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""", 1)
    return collapse_whitespace(html_unescape(a))


def json_array_after(c: Column, marker: str) -> Column:
    """The JSON array that follows a marker in a page: from the first bracket to the one that closes it, outside strings; null if none does.

    Depth is a running sum over the characters that matter, so brackets need no Python.
    """
    tail = F.regexp_extract(F.coalesce(c, F.lit("")), "(?s)" + marker + r"[^\[]*(\[.*)$", 1)
    bare = F.regexp_replace(tail, r'"(?:[^"\\]++|\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]]", ""), "")
    closing = F.aggregate(
        F.transform(marks, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("at")),
        lambda s, m: F.when(s["at"] >= 0, s).otherwise(
            F.struct(
                (s["depth"] + F.when(m["x"] == "[", 1).when(m["x"] == "]", -1).otherwise(0)).alias("depth"),
                F.when((m["x"] == "]") & (s["depth"] == 1), m["i"]).otherwise(F.lit(-1)).alias("at"),
            )
        ),
        lambda s: s["at"],
    )
    pieces = F.regexp_extract_all(tail, F.lit(r'("(?:[^"\\]++|\\.)*+"|[^"\[\]]+|[\[\]]|")'), 1)
    numbered = F.aggregate(
        pieces,
        F.struct(F.lit(-1).alias("k"), F.array().cast("array<string>").alias("out")),
        lambda s, p: F.when(s["k"] >= closing, s).otherwise(F.struct(F.when(p.isin("[", "]"), s["k"] + 1).otherwise(s["k"]).alias("k"), F.concat(s["out"], F.array(p)).alias("out"))),
        lambda s: F.array_join(s["out"], ""),
    )
    return F.when((tail != "") & (closing >= 0), numbered)
