import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from siteloom.llm.lm import scores

from .helpers import documents, odd_texts, prose


def toks(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def d_of(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
    return [min(max(c - (c + 1) * y * n[c] / n[c - 1], 0), c) if n[c - 1] else 0 for c in (1, 2, 3)]


class Slow:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for i, t in enumerate(texts):
            if zlib.crc32(str(i).encode()) % 10:
                w = toks(t)
                self.uni.update(w)
                self.bi.update(zip([None, *w], w))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.follows = Counter(b for _, b in self.bi)
        self.after = defaultdict(list)
        for (a, _), c in self.bi.items():
            self.after[a].append(c)
        self.d2, self.d1 = d_of(self.bi.values()), d_of(self.follows.values())

    def p(self, a, b):
        cut = lambda c, d: c - d[min(c, 3) - 1] if c else 0
        total = sum(self.follows.values())
        p = cut(self.follows[b], self.d1) / total + sum(self.d1[min(c, 3) - 1] for c in self.follows.values()) / total / (self.v + 1)
        if a in self.uni and a in self.after:
            own = self.after[a]
            p = (cut(self.bi[a, b], self.d2) + sum(self.d2[min(c, 3) - 1] for c in own) * p) / sum(own)
        return p


@pytest.mark.parametrize("many", [False, True])
def test_against_brute_force(spark, many):
    texts = [t for t in odd_texts() if len(t or "") < 10_000] + [prose(i % 30, 40) + " the the " * (i % 3) for i in range(120)]
    if many:
        texts = ["the " * 400 + t if t else t for t in texts]  # one word is most of all tokens
    m = Slow(texts)
    got = {r.doc_id: r for r in scores(documents(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, r = toks(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(x in m.uni for x in w), m.n)
        assert math.isclose(r.base_score, sum(math.log10((m.uni[x] + 0.1) / (m.n + 0.1 * (m.v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(m.p(a, b)) for a, b in zip([None, *w], w)), rel_tol=1e-9), i


def test_probabilities_sum_to_one():
    m = Slow([prose(i, 30) for i in range(30)])
    for a in [None, *list(m.uni)[:5], "never seen"]:
        assert math.isclose(sum(m.p(a, b) for b in [*m.uni, "never seen"]), 1, rel_tol=1e-9)


def test_odd_tables(spark):
    assert scores(documents(spark, [])).count() == 0
    long = scores(documents(spark, odd_texts())).collect()
    assert len(long) == len(odd_texts()) and all(math.isfinite(r.score) and r.score < 0 for r in long)
    docs = documents(spark, odd_texts())
    assert scores(docs.unionByName(docs)).count() == 2 * len(odd_texts())
