"""Element trees of pages and the CSS selectors that pick from them.

A selector is a list (",") of compounds (tag, #id, .class, [attribute], :not()) joined by descent (" "), child (">") or a
later sibling ("~"). Whether an element matches is worked out once for each element, from the top down, so the cost of a page
is its elements times the selectors.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening tag of the same kind closes.
CLOSES_ITSELF = frozenset("p li option tr td th dt dd".split())
#: Elements whose text no reader sees.
UNREAD = frozenset("script style noscript template head".split())


class Node:
    """An element: tag, attributes, parent (-1 at the top), elements before it under the same parent, and where its text begins and ends."""

    __slots__ = ("tag", "attrs", "parent", "before", "start", "end", "classes")

    def __init__(self, tag: str, attrs: dict, parent: int, before: list[int], start: int):
        self.tag, self.attrs, self.parent, self.before, self.start, self.end = tag, attrs, parent, before, start, -1
        self.classes = frozenset(attrs.get("class", "").split())


class Page(HTMLParser):
    """All elements of a page in document order, and the pieces of its text."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.pieces: list[str] = []
        self.open: list[int] = []
        self.children: dict[int, list[int]] = {}
        self.feed(html or "")
        self.close()
        for k in self.open:
            self.nodes[k].end = len(self.pieces)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_ITSELF and self.open and self.nodes[self.open[-1]].tag == tag:
            self.handle_endtag(tag)
        parent = self.open[-1] if self.open else -1
        siblings = self.children.setdefault(parent, [])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, parent, siblings, len(self.pieces))
        siblings.append(len(self.nodes))
        if tag in VOID:
            node.end = len(self.pieces)
        else:
            self.open.append(len(self.nodes))
        self.nodes.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]].tag == tag:
                for own in self.open[k:]:
                    self.nodes[own].end = len(self.pieces)
                del self.open[k:]
                return

    def handle_data(self, data):
        if not (self.open and self.nodes[self.open[-1]].tag in UNREAD):
            self.pieces.append(data)

    def text(self, k: int) -> str:
        """An element's text, white space collapsed."""
        n = self.nodes[k]
        return " ".join("".join(self.pieces[n.start : n.end]).split())

    def above(self, k: int):
        """An element and those around it, from the inside out."""
        while k >= 0:
            yield k
            k = self.nodes[k].parent


# ---- selectors ----------------------------------------------------------------------------------------------------

_PART = re.compile(r"""(\*|[a-zA-Z][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*([iI])?\s*)?\]|:not\(([^()]*)\)""")


def _compound(text: str):
    """A test of one element from a compound selector."""
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not a selector: {text!r}")
        tag, own_id, own_class, name, op, v1, v2, v3, fold, no = m.groups()
        if tag and tag != "*":
            tests.append(lambda n, t=tag.lower(): n.tag == t)
        elif own_id:
            tests.append(lambda n, v=own_id: n.attrs.get("id") == v)
        elif own_class:
            tests.append(lambda n, v=own_class: v in n.classes)
        elif name:
            tests.append(_attribute(name.lower(), op, next((v for v in (v1, v2, v3) if v is not None), ""), bool(fold)))
        elif no is not None:
            inner = _compound(no.strip())
            tests.append(lambda n, f=inner: not f(n))
        at = m.end()
    return lambda n: all(t(n) for t in tests)


def _attribute(name: str, op: str | None, value: str, fold: bool):
    if op is None:
        return lambda n: name in n.attrs
    value = value.lower() if fold else value
    compare = {
        "=": lambda x: x == value, "*=": lambda x: value != "" and value in x, "^=": lambda x: value != "" and x.startswith(value), "$=": lambda x: value != "" and x.endswith(value),
        "~=": lambda x: value in x.split(), "|=": lambda x: x == value or x.startswith(value + "-"),
    }[op]
    return lambda n: name in n.attrs and compare(n.attrs[name].lower() if fold else n.attrs[name])


def _split(text: str, at: str) -> list[str]:
    """text split at a character outside brackets and quotes."""
    out, depth, quote, own = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        if c == at and not depth and not quote:
            out.append(own)
            own = ""
        else:
            own += c
    return [*out, own]


def compiled(selector: str) -> list[list[tuple]]:
    """The alternatives of a selector, each as (joint to what is before, test) from left to right."""
    out = []
    for one in _split(selector, ","):
        steps, joint = [], " "
        for word in (w for w in _split(" ".join(one.split()), " ") if w):
            if word in (">", "~"):
                joint = word
            else:
                steps.append((joint, _compound(word)))
                joint = " "
        out.append(steps)
    return out


def _fits(page: Page, k: int, steps: list[tuple], last: int) -> bool:
    joint, test = steps[last]
    if not test(page.nodes[k]):
        return False
    if last == 0:
        return True
    n = page.nodes[k]
    if joint == ">":
        return n.parent >= 0 and _fits(page, n.parent, steps, last - 1)
    if joint == "~":
        return any(_fits(page, s, steps, last - 1) for s in n.before if s < k)
    return any(_fits(page, a, steps, last - 1) for a in page.above(n.parent))


def picked(page: Page, selector: list[list[tuple]], inside: int | None = None) -> list[int]:
    """Elements that match, in document order; `inside`: those within an element only."""
    out = []
    for k in range(len(page.nodes)):
        if inside is not None and (k == inside or inside not in page.above(k)):
            continue
        if any(_fits(page, k, steps, len(steps) - 1) for steps in selector):
            out.append(k)
    return out
