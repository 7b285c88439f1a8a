import random
from itertools import combinations

from pyspark.sql import functions as F

from siteloom.llm.line_dedup import EDITS, LEAST, banded_distance, counted_links, drop_repeated_lines, line_links, repeated_lines, star_counted_links, verified

from .helpers import documents, odd_texts, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def edited(r, s, k):
    s = list(s)
    for _ in range(k):
        p = r.randrange(len(s))
        what = r.randrange(3)
        if what == 0:
            s[p] = r.choice("abcé ")
        elif what == 1:
            s.insert(p, r.choice("abc漢"))
        elif len(s) > 1:
            del s[p]
    return "".join(s)


def test_banded_distance_and_trimming(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(1500):
        a = "".join(r.choice("ab") for _ in range(r.randrange(1, 14)))
        b = edited(r, a, r.randrange(4))
        pairs.append((a, b) if len(a) >= len(b) else (b, a))
    pairs += [("x", ""), ("ab", ""), ("abc", "")]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(4)
    for k in (1, 2, 3):
        for x in df.select("a", "b", F.expr(banded_distance("a", "b", k)).alias("d")).collect():
            want = distance(x.a, x.b)
            assert x.d == want if want <= k else x.d > k, (x, want, k)
        got = sorted((x.a, x.b) for x in verified(df, k).collect())
        assert got == sorted(p for p in pairs if distance(*p) <= k)


def corpus():
    r = random.Random(2)
    base = [prose(i, 9) for i in range(12)] + ["short line here", "x" * 25, "ab" * 15, "\U0001f600 é漢 " * 5]
    docs = []
    for _ in range(60):
        docs.append("\n".join(edited(r, x, r.choice([0, 0, 1, 2, 3])) if r.random() < 0.8 else "" for x in r.sample(base, 4)))
    return [t for t in odd_texts() if len(t or "") < 5000] + docs


def slow(texts):
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    first = {}
    for i, k, x in sorted(lines):
        first.setdefault(x, (i, k))
    long = [x for x in first if len(x) >= LEAST]
    links = {x: set() for x in first}
    for i, a in enumerate(long):
        for b in long[:i]:
            if abs(len(a) - len(b)) <= EDITS and distance(a, b) <= EDITS:
                links[a].add(b)
                links[b].add(a)
    out = {i: [0, 0, []] for i in range(len(texts))}
    for i, k, x in lines:
        out[i][0] += 1
        out[i][1] += len(links[x])
        if first[x] < (i, k) or any(first[y] < first[x] for y in links[x]):
            out[i][2].append(k)
    return out, sum(map(len, links.values())) // 2


def test_against_brute_force(spark):
    texts = corpus()
    want, n = slow(texts)
    docs = documents(spark, texts, extra=True)
    assert line_links(docs)[1].count() == n > 20
    got = {r.doc_id: [r.n_lines, r.n_links, r.dropped] for r in repeated_lines(docs).collect()}
    assert got == want
    kept = {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()}
    for i, t in enumerate(texts):
        assert kept[i] == "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in want[i][2])


def test_long_lines_empty_and_repeated(spark):
    docs = documents(spark, odd_texts())
    a = {r.doc_id: r for r in repeated_lines(docs).collect()}
    assert len(a) == len(odd_texts()) and a[8].n_lines == 1
    b = {r.doc_id: r for r in repeated_lines(docs.unionByName(docs)).collect()}
    assert all(b[i].n_lines == 2 * a[i].n_lines for i in a)
    assert repeated_lines(documents(spark, [])).count() == 0
    assert [r.n_lines for r in repeated_lines(documents(spark, [None, ""])).collect()] == [0, 0]


def third(m):
    step = 1 << max(0, m.bit_length() - 4)
    return m // step * step // 3


def linked(a, b):
    """Whether lines are linked where the threshold grows with the length."""
    if len(a) < len(b):
        a, b = b, a
    m, e = len(b), third(len(b))
    most = 0 if m < 5 else 1 if m < 20 else max(2, m // 10) if m >= 30 and (a[:e] == b[:e] or a[-e:] == b[-e:]) else 2
    return len(a) - m <= most and 0 < distance(a, b) <= most


def test_threshold_grows_with_the_length(spark):
    r = random.Random(4)
    lines = ["abc", "abd", "abcde", "abcdx", "tiny line here", "tiny line herd", "tiny line hers!", "x" * 19, "x" * 20, "x" * 21]
    for i in range(40):
        base = prose(i, r.choice([4, 6, 9, 15, 30]))
        words = base.split(" ")
        words[r.randrange(len(words))] = "another"  # an exchanged word
        lines += [base, " ".join(words), base + " tail", edited(r, base, r.randrange(1, 9)), edited(r, base[: len(base) // 2], 4) + base[len(base) // 2 :]]
    lines = sorted(set(lines))
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if linked(a, b)}
    classes, links = line_links(documents(spark, ["\n".join(lines)]), grow=True)
    name = {x.id: x.line for x in classes.collect()}
    got = [(name[x.u], name[x.v]) for x in links.collect()]
    assert {frozenset(p) for p in got} == want and len(got) == len(want)
    assert any(distance(*p) > 5 for p in want) and any(max(map(len, p)) < 20 for p in want)


def test_near_copies_are_counted_without_their_pairs(spark):
    r = random.Random(5)
    texts = []
    for base, many in ((prose(1, 45), 60), (prose(2, 40) + " " + prose(1, 5), 30), (prose(3, 60)[: 512 - 8], 40)):
        texts += [base, base]
        for _ in range(many):  # about a border between length classes, some with edits at both ends, in one third or the middle
            a = base if r.random() < 0.7 else r.choice(texts)
            k, at = r.randrange(1, 10), r.choice([0, len(a) // 3, len(a) // 2, 2 * len(a) // 3])
            texts.append(a[:at] + edited(r, a[at : at + len(a) // 4], k) + a[at + len(a) // 4 :] + r.choice(["", "", " and more"]))
    first = {}
    for i, x in enumerate(texts):
        first.setdefault(x, i)
    links = {x: set() for x in first}
    for a, b in combinations(first, 2):
        if linked(a, b):
            links[a].add(b)
            links[b].add(a)
    docs = documents(spark, texts)
    classes, cores, pairs = counted_links(docs)
    every, n = line_links(docs, grow=True)[1], sum(map(len, links.values())) // 2
    assert every.count() == n > 1000 and pairs.count() < n / 2
    in_cores = {x.id: set(x.cores) for x in cores.collect()}
    shared = [(x.u, x.v) for x in every.collect() if in_cores.get(x.u, set()) & in_cores.get(x.v, set())]
    assert len(shared) + pairs.count() == n and max(map(len, in_cores.values())) > 2
    got = {x.doc_id: (x.n_links, x.n_dropped) for x in repeated_lines(docs, grow=True).collect()}
    assert got == {i: (len(links[x]), int(first[x] < i or any(first[y] < first[x] for y in links[x]))) for i, x in enumerate(texts)}


def test_lines_far_from_a_center_are_counted_without_their_pairs(spark):
    r = random.Random(6)
    texts = []
    for base, edits in ((prose(7, 25), (1, 2, 3, 10, 12)), (prose(8, 30)[: 128 - 4], (0, 1, 2, 7, 8))):
        texts += [base] * 3
        for i in range(30):  # edits near the center and beyond a 21st of its length, in the middle, the first or the last third
            at, k = len(base) * (i % 3) // 3, edits[i % 5]
            texts.append(base[:at] + edited(r, base[at : at + len(base) // 3], k) + base[at + len(base) // 3 :])
    docs = documents(spark, texts)
    first = {}
    for i, x in enumerate(texts):
        first.setdefault(x, i)
    links = {x: set() for x in first}
    for a, b in combinations(first, 2):
        if linked(a, b):
            links[a].add(b)
            links[b].add(a)
    n = sum(map(len, links.values())) // 2
    classes, stars, pairs = star_counted_links(docs)
    name, spots = {x.id: x.line for x in classes.collect()}, {x.id: x for x in stars.collect()}
    near = lambda a, b: a.star == b.star and a.kinds & b.kinds and a.far + b.far <= min(a.most, b.most)
    told = [frozenset((name[a.id], name[b.id])) for a, b in combinations(spots.values(), 2) if near(a, b)]
    written = [frozenset((name[x.u], name[x.v])) for x in pairs.collect()]
    assert {*told, *written} == {frozenset((a, b)) for a in links for b in links[a]} and len(told) + len(written) == n
    # pairs of one line near the center and one far from it: with cores they were written
    assert len(written) < n / 10 < counted_links(docs)[2].count()
    got = {x.doc_id: (x.n_links, x.n_dropped) for x in repeated_lines(docs, grow=True).collect()}
    assert got == {i: (len(links[x]), int(first[x] < i or any(first[y] < first[x] for y in links[x]))) for i, x in enumerate(texts)}


def test_query_links_exchanged_words_and_short_lines(spark, tmp_path):
    from siteloom.llm.queries import op2_line_dedup

    base = prose(1, 30)
    texts = [base, base.replace(base.split(" ")[15], "something"), "short line here", "short line hers", "abc", "abd"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    assert [x.dropped for x in op2_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == ["", "0", "", "0", "", ""]


def test_rows_of_one_id_keep_their_own_lines(spark):
    rows = [(1, "a line that is there twice\nits own first"), (2, "another line\nits own second"), (2, "a line that is there twice\nits own third"), (2, None), (None, "")]
    out = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, ""), (1, rows[0][1]), (2, ""), (2, rows[1][1]), (2, "its own third")]
