import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline

from .helpers import documents, prose
from .test_decontaminate import slow as contaminated
from .test_exact_and_simhash import norm, slow_components, slow_print
from .test_toxicity import labelled


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept: toxicity by the planted words, the rest by definition."""
    texts, labels = labelled(spark, 240)
    bench = [(0, prose(77, 30))]
    texts += [texts[1], texts[2] + "\n", prose(900, 200), prose(900, 200) + " x", "intro " + bench[0][1], None, "", prose(901, 900) + " " + " ".join(bench[0][1].split()[3:20]) + " " + prose(902, 900)]
    for name, df in (("documents", documents(spark, texts, extra=True)), ("labels", labels), ("benchmark", spark.createDataFrame(bench, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = set(range(len(texts))), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == kept
            break
        assert docs.columns == columns
        got = {r.doc_id for r in docs.collect()}
        if name == "toxicity":
            want = {i for i in kept if not any(w in (texts[i] or "") for w in ("vermin", "filth"))}
            assert len(got ^ want) <= 0.03 * len(texts) and {i for i in want if i >= 240} <= got
            want = got
        elif name == "exact_dedup":
            want = {min(j for j in kept if norm(texts[j]) == norm(texts[i])) for i in kept}
        elif name == "near_dedup":
            want = set(slow_components({i: slow_print(texts[i]) for i in kept}).values())
        else:
            want = {i for i in kept if not contaminated(texts[i], bench)[1]}
            assert {244, 247} <= kept and not {244, 247} & want  # a short passage in a long document goes, too
            assert not contaminated(texts[247], bench)[4]
        assert got == want, name
        kept = got
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(kept)


def test_empty_tables(spark, tmp_path):
    """Without rows no stage fails; without labels and items documents go on to the end."""
    none, some = documents(spark, []), documents(spark, [None, "", "one", "one", prose(3, 50)])
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for k, docs in enumerate((none, some)):
        for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            df.write.parquet(f"{tmp_path}/{k}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/0").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/1").collect()} == {0, 2, 4}
