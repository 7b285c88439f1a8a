import hashlib
import re

import numpy as np
import xxhash

from siteloom.llm.exact_dedup import drop_exact_duplicates, exact_groups
from siteloom.llm.simhash import drop_near_duplicates, links_at, masks, near_duplicates

from .helpers import documents, odd_texts, prose


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups_against_brute_force(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in exact_groups(documents(spark, texts, extra=True), digest=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, x in enumerate(texts) if norm(x) == norm(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), i == min(same))
        assert r.text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()


def test_exact_groups_without_small_groups_sent(spark):
    texts = odd_texts()
    a = sorted(exact_groups(documents(spark, texts)).collect())
    assert a == sorted(exact_groups(documents(spark, texts), send_rows=0).collect())


def test_exact_drop_keeps_columns_and_one_row(spark):
    docs = documents(spark, odd_texts(), extra=True)
    twice = docs.unionByName(docs)
    out = drop_exact_duplicates(twice)
    assert out.columns == docs.columns
    texts = odd_texts()
    first = {norm(t): i for i, t in reversed(list(enumerate(texts)))}
    assert sorted(r.doc_id for r in out.collect()) == sorted(first.values())


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert exact_groups(docs).count() == 0 and drop_exact_duplicates(docs).count() == 0
    assert near_duplicates(docs).count() == 0 and drop_near_duplicates(docs).count() == 0


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_texts():
    base = prose(5, 400).split()
    out = odd_texts() + [prose(9, 3), prose(9, 4)]
    for k in range(60):
        w = list(base)
        for j in range(k % 7):
            w[(k * 13 + j * 29) % len(w)] = f"changed{k}x{j}"
        out.append(" ".join(w))
    return out


def test_simhash_against_brute_force(spark):
    texts = near_texts()
    got = {r.doc_id: r for r in near_duplicates(documents(spark, texts, extra=True)).collect()}
    prints = {i: slow_print(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_components(prints)


def test_ball_links_equal_all_pairs():
    r = np.random.default_rng(3)
    centre = r.integers(0, 2**63, 40).astype(np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(1, 6), replace=False))) for c in centre for _ in range(8)]
    fps = np.unique(np.concatenate([centre, np.array(near, np.uint64)]))
    label = {int(f): int(f) for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for p in range(256):
        own = fps[np.bitwise_count((fps >> np.uint64(56)) ^ np.uint64(p)) <= 2]
        for a, b in zip(*links_at(p, 8, own, 4)):
            assert (int(a) ^ int(b)).bit_count() <= 64
            x, y = find(int(a)), find(int(b))
            label[max(x, y)] = min(x, y)
    want = slow_components({int(f): int(f) for f in fps})
    assert {x: find(x) for x in label} == want
    assert len(masks(64, 2)) == 2081


def test_simhash_drop(spark):
    texts = near_texts()
    out = drop_near_duplicates(documents(spark, texts, extra=True))
    want = set(slow_components({i: slow_print(t) for i, t in enumerate(texts)}).values())
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_drops_with_clashing_and_null_ids(spark):
    rows = [(1, "a"), (1, "b"), (5, "a"), (5, "c"), (None, "c"), (None, "d"), (None, "d"), (2, "b"), (5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(drop_exact_duplicates(docs).collect(), key=str)
    assert sorted(map(tuple, out), key=str) == sorted([(1, "a"), (1, "b"), (5, "c"), (None, "d")], key=str)
    near = sorted(drop_near_duplicates(docs).collect(), key=str)
    assert sorted(map(tuple, near), key=str) == sorted([(1, "a"), (1, "b"), (5, "c"), (None, "d")], key=str)


def test_drops_beyond_the_size_that_is_sent(spark):
    from siteloom.llm.common import Stage, drop_rows, row_key

    docs = documents(spark, odd_texts(), extra=True)
    gone = docs.filter("doc_id % 3 = 0").select(row_key())
    a, b = (sorted(r.doc_id for r in drop_rows(docs, gone, Stage(spark, "t"), send=k).collect()) for k in (0, 100))
    assert a == b == [i for i in range(len(odd_texts())) if i % 3]
