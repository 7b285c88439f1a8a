import hashlib
import random
import re

from siteloom.llm.common import Stage
from siteloom.llm.pii import KINDS, candidates, digest, find, redact, train, trees_to_sql

from .helpers import documents, odd_texts, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def noise(seed):
    r = random.Random(seed)
    bits = ["a@b.c", "_d@e.f", "x.y%z@q-r.s.t", "1.2.3.4", "300.1.1.1", "001.02.3.255.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+46 (0)8-123 456 78", "+1", "+12345678", "@", ".", " ", "-", "é", "\U0001f600", "漢", "\n", "12", "mail me at joe (at) site dot org", "call 08-123 45 67"]
    return "".join(r.choice(bits) + r.choice(["", "", " "]) for _ in range(r.randrange(60)))


def test_base_spans_against_brute_force(spark):
    texts = odd_texts() + [noise(i) for i in range(120)] + ["9" * 20_000, "a" * 20_000, "a.b@" * 3_000, "1 " * 20_000, "a@b" + ".c" * 20_000, "joe@site.org " * 500, "+" + "1(" * 9_000]
    got = {r.doc_id: r for r in digest(find(documents(spark, texts, extra=True))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = slow(t)
        line = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in want) for k in KINDS), (i, t[:80] if t else t)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_nothing_to_learn_from(spark):
    assert digest(find(documents(spark, []))).count() == 0
    r = digest(find(documents(spark, ["plain", None]))).collect()
    assert all(x.spans == "" and x.base_sha256 == hashlib.sha256(b"").hexdigest() for x in r)


def test_redact(spark):
    texts = [prose(i, 20) + " joe@site.org and 10.0.0.1 end" for i in range(20)] + [prose(i, 5) + " 1.2.3.400 no 12 34" for i in range(20)]
    out = {r.doc_id: r.text for r in redact(documents(spark, texts)).collect()}
    assert out[0] == prose(0, 20) + " [email] and [ip] end"
    assert out[25] == texts[25]
    same = spark.createDataFrame([(1, "joe@site.org aa"), (1, "zz 10.0.0.1"), (1, "zz 10.0.0.1"), (None, "kim@site.org"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in redact(same).collect()) == [(0, ""), (0, "[email]"), (1, "[email] aa"), (1, "zz [ip]"), (1, "zz [ip]")]


def test_trees_to_sql(spark):
    text = "G: uid=x\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     Predict: -1.0\n    Else (feature 0 > 1.5)\n     If (feature 1 <= 0.0)\n      Predict: 0.25\n     Else (feature 1 > 0.0)\n      Predict: 1.0\n  Tree 1 (weight 0.5):\n    Predict: 2.0\n"
    sql = trees_to_sql(text, "f")
    got = spark.sql(f"select {sql} as r from values (array(1D, 0D)), (array(2D, 0D)), (array(2D, 3D)) as t(f)").collect()
    assert [r.r for r in got] == [0.0, 1.25, 2.0]


def planted(n):
    """Texts with a wide candidate that is personal data, or isn't, and its span if it is."""
    r, out = random.Random(5), []
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    for i in range(n):
        lead, tail = prose(i, 6) + " ", " " + prose(i + n, 6)
        number = r.choice([f"08-{d(3)} {d(2)} {d(2)}", f"(555) {d(3)}-{d(4)}", f"0{d(9)}"])
        address = r.choice([f"joe{d(2)} (at) site dot org", f"ann [at] mail{d(1)}.example.net", f"kim at host{d(2)} dot com"])
        for word, x, kind in ((r.choice(["call ", "phone ", "fax: "]), number, "phone"), (r.choice(["contact ", "mail "]), address, "email")):
            out.append((lead + word + x + tail, f"{kind}:{len(lead + word)}:{len(lead + word + x)}"))
        for x in (f"token{d(8)}beta", "9" + d(14) + "77", f"stayed at home.Then{d(2)}", f"on 2024-0{1 + i % 9}-1{d(1)}", f"order {d(3)}-{d(3)}-{d(4)}"):
            out.append((lead + x + tail, ""))
    return out


def test_planted_wide_candidates_are_found(spark):
    for n in (60, 1):
        cases = planted(n)
        docs = documents(spark, [t for t, _ in cases])
        assert n == 1 or "exp" in train(candidates(docs, "doc_id", "text"), Stage(spark, "pii"))[0]  # the trees decide
        got = {r.doc_id: r.spans for r in digest(find(docs)).collect()}
        found = [got[i] == want for i, (_, want) in enumerate(cases) if want]
        clean = [got[i] == "" or got[i].startswith("card") for i, (_, want) in enumerate(cases) if not want]  # a drawn number may have right check digits
        assert all(found), [(cases[i], got[i]) for i, (_, want) in enumerate(cases) if want and got[i] != want][:5]
        assert all(clean), [(cases[i], got[i]) for i, (_, want) in enumerate(cases) if not want and got[i]][:5]
    reaching = "call 08-123 45 67 10.0.0.1"  # a wide candidate that overlaps a base match
    assert digest(find(documents(spark, [reaching]))).head().spans == f"ip:18:26,phone:5:{len(reaching)}"


def luhn_number(r):
    d = "".join(r.choice("123456789") for _ in range(15))
    return next(d + x for x in "0123456789" if luhn(d + x))


def test_wide_forms_of_base_matches_are_learned(spark):
    """Plain base matches teach their written-out forms: what is told apart without any word before it."""
    r = random.Random(8)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    base = [f"{prose(i, 8)} {x} {prose(i + 500, 4)}" for i in range(120) for x in (f"joe{d(2)}@site{d(1)}.org", f"+46 8 {d(3)} {d(2)} {d(2)}", luhn_number(r))]
    dots = lambda x: ".".join(x[i : i + 4] for i in range(0, 16, 4))
    bad = lambda x: x[:-1] + str((int(x[-1]) + 1) % 10)
    wide, decoys = [], []
    for i in range(40):
        n = luhn_number(r)
        wide += [(f"kim{d(2)} (at) host{d(1)}.net", "email"), (dots(n), "card"), (f"0046 8 {d(3)} {d(2)} {d(2)}", "phone")]
        decoys += [dots(bad(n)), f"waited at home.The{d(1)}", ".".join("9" + d(2) for _ in range(4))]  # no ip: its parts are above 255
    texts = base + [f"{prose(i, 5)} {x} end" for i, (x, _) in enumerate(wide)] + [f"{prose(i, 5)} {x} end" for i, x in enumerate(decoys)]
    got = {q.doc_id: q.spans for q in digest(find(documents(spark, texts))).collect()}
    hit = [got[len(base) + i].startswith(f"{k}:{len(prose(i, 5)) + 1}:") for i, (_, k) in enumerate(wide)]
    false = [got[len(base) + len(wide) + i] != "" for i in range(len(decoys))]
    assert sum(hit) >= 0.9 * len(hit), [(wide[i], got[len(base) + i]) for i, h in enumerate(hit) if not h][:5]
    assert sum(hit) / (sum(hit) + sum(false)) >= 0.95, [(decoys[i], got[len(base) + len(wide) + i]) for i, h in enumerate(false) if h][:5]


def test_all_labelled_candidates_are_learned_from(spark):
    """What counts are given is not cut at `rows`: a rare kind of candidate reaches the thresholds however many others there are."""
    docs = documents(spark, [t for t, _ in planted(60)])
    stage = Stage(spark, "pii")
    train(candidates(docs, "doc_id", "text"), stage, rows=8)
    [learned] = [p for p in stage.paths.values() if p.endswith("-labelled")]
    every = spark.read.parquet(learned)
    assert every.agg({"n": "sum"}).head()[0] > 8 and every.count() == every.dropDuplicates(["f", "label", "own", "kind", "half"]).count()
    assert train(candidates(docs, "doc_id", "text"), stage, rows=8)[1]["phone"] is not None
