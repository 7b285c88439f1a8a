import hashlib
import random
import re
from collections import Counter

from siteloom.llm.decontaminate import WINDOW, contamination, drop_contaminated, matches

from .helpers import documents, odd_texts, prose


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for i in range(max(1, len(x) - WINDOW + 1) if x else 0):
            win = x[i : i + WINDOW]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases(spark):
    items = [(0, prose(11, 30)), (1, prose(12, 13)), (2, "Short item, 3 words"), (3, None), (4, "  "), (10, prose(11, 30)), (11, "漢字 é")]
    a, b = items[0][1], items[1][1]
    texts = odd_texts() + [a, "before " + b + " after", prose(3, 400) + " " + a[: len(a) // 2], " ".join([b] * 3), b.upper().replace(" ", ", "), "a short ITEM; 3-words b", a + "\n" + a, "x 漢字, É", "x 漢字, é", " ".join(b.split()[:12])]
    return items, texts, spark.createDataFrame(items, "item_id long, text string")


def check(got, items, texts):
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == slow(texts[r.doc_id], items), r


def test_against_brute_force(spark):
    items, texts, bench = cases(spark)
    check(contamination(documents(spark, texts, extra=True), bench).collect(), items, texts)


#: Every segment a few documents, every bucket a few words, every word frequent that occurs twice in a segment.
TINY = {"segment_bytes": 2_000, "bucket_bytes": 3_000, "most": 5, "frequent": 1}


def test_sizes_give_the_same(spark):
    items, texts, bench = cases(spark)
    texts = [t for t in texts if len(t or "") < 20_000]
    check(contamination(documents(spark, texts), bench, **TINY).collect(), items, texts)
    check(contamination(documents(spark, texts), bench, **(TINY | {"frequent": 10_000, "bucket_bytes": 400_000})).collect(), items, texts)
    one = {r.doc_id: sorted(map(tuple, r.matches)) for r in matches(documents(spark, texts), bench).collect()}
    assert one == {r.doc_id: sorted(map(tuple, r.matches)) for r in matches(documents(spark, texts), bench, **TINY).collect()}
    for r in matches(documents(spark, texts), bench).collect():
        covered = {p for m in r.matches for p in range(m.start, m.start + m.length)}
        assert len(covered) == slow(texts[r.doc_id], items)[1]


def test_items_without_an_id_and_repeated_ones(spark):
    texts = ["x " + prose(5, 20), prose(6, 20) + " y", "none of it"]
    bench = spark.createDataFrame([(None, prose(5, 20)), (None, prose(6, 20)), (3, prose(6, 20)), (3, prose(6, 20)), (4, prose(6, 20))], "item_id long, text string")
    got = sorted(contamination(documents(spark, texts), bench).collect())
    digest = lambda *ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert [(r.n_hit, r.n_items, r.items_sha256) for r in got] == [(20, 1, digest()), (20, 3, digest("3", "4")), (0, 0, digest())]


def near(text, phrase, span, n):
    """Places of the phrase's rarest word (fewest in all texts, first of those) with all its words nearby."""
    w = words(text)
    rarest = min(phrase, key=lambda x: (n[x], phrase.index(x)))
    return {i for i, x in enumerate(w) if x == rarest and all(p in w[max(0, i - span) : i + span + 1] for p in phrase)}


def test_proximity_against_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 60))) for _ in range(80)] + ["", None]
    bench = [(i, " ".join(r.sample("abcdefgh", r.randrange(1, 6)))) for i in range(12)]
    n = Counter(x for t in texts for x in words(t))
    for sizes in ({}, TINY):
        for d in contamination(documents(spark, texts), spark.createDataFrame(bench, "item_id long, text string"), span=7, **sizes).collect():
            t = texts[d.doc_id]
            want = set().union(*(near(t, words(b), 7, n) for _, b in bench))
            assert (d.n_near, d.n_hit) == (len(want), slow(t, bench)[1])


def test_proximity(spark):
    bench = spark.createDataFrame([(0, "red green blue")], "item_id long, text string")
    docs = documents(spark, ["red green blue", "blue x green y red", "red " + "x " * 9 + "green blue", "red green"])
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in matches(docs, bench, span=4).collect()}
    assert got[0][0] == ("0", 0, 0) or ("0", 0, 3) in got[0]
    assert len(got[1]) == 1 and got[1][0][2] == 0 and got[2] == [] and got[3] == []


def test_empty_and_drop(spark):
    items, texts, bench = cases(spark)
    assert contamination(documents(spark, []), bench).count() == 0
    assert contamination(documents(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0
    docs = documents(spark, texts, extra=True)
    out = drop_contaminated(docs.unionByName(docs), bench)
    assert out.columns == docs.columns
    want = [i for i, t in enumerate(texts) if not slow(t, items)[1]]
    assert sorted(r.doc_id for r in out.collect()) == sorted(want * 2)
    mostly = [i for i, t in enumerate(texts) if not slow(t, items)[4]]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench, share=20).collect()) == sorted(mostly) != sorted(want)
    assert drop_contaminated(documents(spark, []), bench).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == len(texts)
