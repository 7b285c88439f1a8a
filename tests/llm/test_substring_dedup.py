import hashlib
import random

import numpy as np
import pytest

from siteloom.llm.substring_dedup import COUNTED, HOT_BYTES, digest, matching_statistics, remove_repeats, repeated_windows

from .helpers import documents, odd_texts, prose


def slow(texts, length):
    where = {}
    raw = [(t or "").encode() for t in texts]
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((d, i))
    gone = [np.zeros(len(b), bool) for b in raw]
    for own in where.values():
        if len(own) > 1:
            for d, i in own:
                gone[d][i : i + length] = True
    out = {}
    for d, b in enumerate(raw):
        g = gone[d]
        kept = bytes(np.frombuffer(b, np.uint8)[~g].tobytes()) if len(b) else b""
        out[d] = (len(b), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repetitive(seed, n):
    r = random.Random(seed)
    passages = [prose(r.randrange(9999), r.randrange(20, 120)) for _ in range(6)]
    out = []
    for i in range(n):
        own = [r.choice(passages) if r.random() < 0.5 else prose(r.randrange(10**6), r.randrange(1, 80)) for _ in range(r.randrange(1, 5))]
        t = list(" ".join(own))
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = "é"
        out.append("".join(t))
    return out + ["abcde" * 200, "xy" * 50 + "abcde" * 100, "z" * 1500, "short"]


@pytest.mark.parametrize("length,n,hot_bytes", [(400, 40, HOT_BYTES), (400, 40, 0), (60, 40, HOT_BYTES), (60, 40, 300), (24, 25, HOT_BYTES), (24, 25, 0)])
def test_against_brute_force(spark, length, n, hot_bytes):
    texts = [t for t in odd_texts() if len(t or "") < 20_000] + repetitive(length, n)
    texts += [prose(4, 60) + " " + prose(i, 3) for i in range(20)]  # one passage, and something else after each copy
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digest(remove_repeats(documents(spark, texts, extra=True), length=length, hot_bytes=hot_bytes, counted=COUNTED if hot_bytes else 500)).collect()}
    assert got == slow(texts, length)


def test_texts_of_every_period(spark):
    texts = [(prose(p, 20)[: p - 1] + "|") * (200 // p + 3) for p in range(2, 60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digest(remove_repeats(documents(spark, texts), length=40)).collect()}
    assert got == slow(texts, 40)


def test_long_and_repeated_and_empty(spark):
    docs = documents(spark, odd_texts())
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    n = len(odd_texts()[8])
    assert got[8].n_removed == n and got[9].n_removed == n and bytes(got[9].kept) == b" end"
    twice = remove_repeats(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(odd_texts())
    assert all(r.n_removed == r.n_bytes for r in twice if r.n_bytes >= 400) and all(not r.n_removed for r in twice if r.n_bytes < 400)
    assert remove_repeats(documents(spark, [])).count() == 0


def test_matching_statistics_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        parts = [np.frombuffer("".join(r.choice("ab") for _ in range(r.randrange(1, 25))).encode(), np.uint8) for _ in range(r.randrange(1, 5))]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        text = np.zeros(ends[-1] + 1, np.uint64)
        for p, e in zip(parts, ends):
            text[e - len(p) : e] = p.astype(np.uint64) + 1
        got = matching_statistics(text, ends)
        suffix = [text[i : ends[np.searchsorted(ends, i)]].tolist() for i in range(len(text))]

        def common(a, b):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            return k

        for i in range(len(text)):
            if text[i]:
                assert got[i] == max((common(suffix[i], suffix[j]) for j in range(len(text)) if j != i), default=0)
        for hits, p in zip(repeated_windows(parts, 4), parts):
            b = p.tobytes()
            every = [q.tobytes()[i : i + 4] for q in parts for i in range(len(q) - 3)]
            assert hits.tolist() == [i for i in range(len(b) - 3) if every.count(b[i : i + 4]) > 1]
