"""Secret scans with a trigram inverted index.

Each rule's regex is parsed and turned into a Boolean query over trigrams that every match must contain. Documents are
indexed in segments: for each trigram the ascending list of documents that have it. A query intersects and unites those
lists; only the documents that remain are searched with the regex. A rule whose regex has no mandatory trigram scans all.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

try:  # the standard parser moved in 3.11
    from re import _constants as sre_constants
    from re import _parser as sre_parse
except ImportError:
    import sre_constants
    import sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import ASCII_LOWER, by_value, small_batches, text_buffer, trimmed

by_value(__name__)

#: Documents in a segment: their numbers fit a byte, so an entry of the index is one 32-bit integer while it is made.
SEGMENT_DOCS = 256
#: Characters that stand for themselves in at most so many ways are followed; wider classes end a literal.
WIDEST_CLASS, MOST_STRINGS = 4, 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group: the part whose length counts; least: that length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.IGNORECASE | re.ASCII if self.ignore_case else re.ASCII)


#: The base kinds in order of their listing, then what the method adds: formats that issuers document.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)


# ---- from a regex to a trigram query ------------------------------------------------------------------------------
# A query is True (every document may match), a trigram, or ("and" | "or", frozenset of queries).


def both(*queries):
    parts = set()
    for q in queries:
        if q is not True:
            parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def either(*queries):
    if any(q is True for q in queries):
        return True
    parts = set()
    for q in queries:
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings: set[bytes]):
    """Some one of the strings is there."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) if len(s) > 2 else True for s in strings)) if strings else True


def _fold(c: int) -> bytes:
    return chr(c).encode().translate(ASCII_LOWER)


class _Run:
    """What is known of the text that a stretch of the regex matches: a query, and, as far as they are few, its exact strings."""

    def __init__(self):
        self.query, self.exact = True, {b""}

    def flush(self):
        self.query, self.exact = both(self.query, _of_strings(self.exact)), {b""}

    def add(self, strings: set[bytes]):
        longer = {a + b for a in self.exact for b in strings}
        if len(longer) > MOST_STRINGS:
            self.query = both(self.query, _of_strings(self.exact))
            # the last two bytes go on, so that trigrams over the border are not lost
            longer = {a[-2:] + b for a in self.exact for b in strings}
            if len(longer) > MOST_STRINGS:
                longer = strings
        self.exact = longer


def _walk(tokens, run: _Run) -> None:
    c = sre_constants
    for op, arg in tokens:
        if op is c.LITERAL:
            run.add({_fold(arg)})
        elif op is c.IN:
            own: set[bytes] | None = set()
            for kind, x in arg:
                if kind is c.LITERAL:
                    own.add(_fold(x))
                elif kind is c.RANGE and x[1] - x[0] < WIDEST_CLASS:
                    own |= {_fold(y) for y in range(x[0], x[1] + 1)}
                else:
                    own = None
                    break
                if len(own) > WIDEST_CLASS + 1:
                    own = None
                    break
            run.add(own) if own else run.flush()
        elif op is c.SUBPATTERN:
            _walk(arg[-1], run)
        elif op is c.BRANCH:
            _unite(run, arg[1])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, getattr(c, "POSSESSIVE_REPEAT", None)):
            least, most, what = arg
            if (least, most) == (0, 1):
                _unite(run, [[], what])
            else:
                for _ in range(min(least, 3)):
                    _walk(what, run)
                if most != least or least > 3:
                    run.flush()
        elif op is c.AT:
            pass
        else:
            run.flush()


def _unite(run: _Run, branches) -> None:
    ways = []
    for b in branches:
        own = _Run()
        _walk(b, own)
        ways.append(own)
    if all(w.query is True for w in ways):
        run.add(set().union(*(w.exact for w in ways)))
    else:
        run.flush()
        run.query = both(run.query, either(*(both(w.query, _of_strings(w.exact)) for w in ways)))


def trigram_query(pattern: str):
    """The Boolean query over lower-cased byte trigrams that the text of every match satisfies; True if there is none."""
    run = _Run()
    _walk(sre_parse.parse(pattern), run)
    run.flush()
    return run.query


# ---- the index ----------------------------------------------------------------------------------------------------


class Segment:
    """Trigrams of at most SEGMENT_DOCS documents, each with the ascending list of documents that have it."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = np.frombuffer(ASCII_LOWER, np.uint8)[raw]
        self.docs = len(offsets) - 1
        if len(low) < 3:
            self.trigrams = self.ends = np.zeros(0, np.int64)
            self.lists = np.zeros(0, np.uint8)
            return
        wide = low.astype(np.uint32)
        entry = (wide[:-2] << 24) | (wide[1:-1] << 16) | (wide[2:] << 8)
        doc = np.repeat(np.arange(self.docs, dtype=np.uint32), np.diff(offsets))
        inside = doc[:-2] == doc[2:]
        entry = np.sort((entry | doc[:-2])[inside])
        entry = entry[np.concatenate([[True], entry[1:] != entry[:-1]])] if len(entry) else entry
        code = entry >> 8
        last = np.flatnonzero(np.concatenate([code[1:] != code[:-1], [True]])) if len(code) else np.zeros(0, np.int64)
        self.trigrams, self.ends, self.lists = code[last].astype(np.int64), last + 1, (entry & 255).astype(np.uint8)

    def postings(self, trigram: bytes) -> np.ndarray:
        code = trigram[0] << 16 | trigram[1] << 8 | trigram[2]
        k = int(np.searchsorted(self.trigrams, code))
        if k == len(self.trigrams) or self.trigrams[k] != code:
            return np.zeros(0, np.uint8)
        return self.lists[self.ends[k - 1] if k else 0 : self.ends[k]]

    def answer(self, query) -> np.ndarray:
        """Documents that satisfy the query."""
        if query is True:
            return np.arange(self.docs, dtype=np.uint8)
        if isinstance(query, bytes):
            return self.postings(query)
        found = sorted((self.answer(q) for q in query[1]), key=len)
        out = found[0]
        for x in found[1:]:
            if query[0] == "and" and not len(out):
                break
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """One row per input row: doc_id and spans (kind, start, end, in code points), by start, then in the rules' order.

    Matches are leftmost and do not overlap within a kind; those too short for the rule are left out and nothing is tried
    again inside them. Null texts count as empty; whole texts are read, however long. Repeated rows are answered each.
    """
    if not 1 <= segment_docs <= SEGMENT_DOCS:
        raise ValueError("a segment's document numbers have to fit a byte")
    plan = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]

    def rows(batches):
        for b in batches:
            raw, at = text_buffer(b.column(1))
            for cut in range(0, b.num_rows, segment_docs):
                to = min(cut + segment_docs, b.num_rows)
                seg = Segment(raw[at[cut] : at[to]], at[cut : to + 1] - at[cut])
                ask: list[list[int]] = [[] for _ in range(to - cut)]
                for k, (_, _, query) in enumerate(plan):
                    for d in seg.answer(query).tolist():
                        ask[d].append(k)
                out = []
                for d, ks in enumerate(ask):
                    text = raw[at[cut + d] : at[cut + d + 1]].tobytes().decode("utf-8", "replace") if ks else ""
                    found = []
                    for k in ks:
                        rule, regex, _ = plan[k]
                        found += [(m.start(), k, m.end()) for m in regex.finditer(text) if len(m[rule.group]) >= rule.least]
                    out.append([{"kind": rules[k].kind, "start": a, "end": z} for a, k, z in sorted(found)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(cut, to - cut), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(rows), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans, from what scan() found."""
    base = [r.kind for r in rules if r.base]
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    own = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def expected_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()
