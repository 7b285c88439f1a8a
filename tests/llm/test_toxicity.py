import random
import zlib

from siteloom.llm.toxicity import drop_toxic, swap_identity_terms, toxicity, train

from .helpers import documents, odd_texts, prose


def labelled(spark, n=400):
    """A third is abuse; most abuse, and a few neutral texts, name a group of people."""
    r = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        t = prose(i, 30).split()
        if bad:
            t.insert(r.randrange(len(t)), r.choice(["vermin", "filth"]))
        if r.random() < (0.9 if bad else 0.1):
            t.insert(r.randrange(len(t)), "muslim")
        texts.append(" ".join(t))
        labels.append((i, 1, int(bad)))
    return texts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_contract(spark):
    texts, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity(documents(spark, texts, extra=True), labels).collect()}
    assert len(got) == len(texts)
    out = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(out)) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == int(i % 3 == 0) for i in out) / len(out) > 0.95


def test_neutral_mentions_score_lower_with_the_penalty(spark):
    texts, labels = labelled(spark)
    docs = documents(spark, texts)
    probe = documents(spark, [prose(1000 + i, 30) + " muslim" for i in range(50)], start=10_000)
    from siteloom.llm.toxicity import score

    mean = lambda m: score(probe, m).agg({"score": "avg"}).head()[0]
    free, paid = train(docs, labels, penalty=0.0), train(docs, labels, penalty=20.0)
    assert mean(paid) < mean(free)


def test_swaps():
    assert swap_identity_terms("A Muslim woman said") == "A christian man said"
    assert swap_identity_terms("nothing here") == "nothing here"


def test_odd_input(spark):
    texts, labels = labelled(spark, 60)
    odd = documents(spark, odd_texts(), start=1000)
    got = toxicity(documents(spark, texts).unionByName(odd).unionByName(odd), labels).filter("doc_id >= 1000").collect()
    assert len(got) == 2 * len(odd_texts()) and all(r.score is not None and r.score < 0.5 for r in got)
    none = labels.limit(0)
    assert {r.predicted for r in toxicity(odd, none).collect()} == {0}
    assert toxicity(documents(spark, []), labels).count() == 0
    docs = documents(spark, texts, extra=True)
    assert drop_toxic(docs, labels).columns == docs.columns
    nulls = spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)
    assert toxicity(docs, labels.unionByName(nulls)).count() == 60
