import corpus_pipeline
from corpuslens.llm.leaks import find_leaks
from corpuslens.llm.lines import duplicate_lines
from corpuslens.llm.neardup import near_duplicates
from corpuslens.llm.quality import fit, score

from ..conftest import TINY
from .test_lines import brute as brute_lines
from .test_neardup import brute as brute_near
from .test_packing import check


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").cache()
    whole = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, TINY).cache()
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        if name == "quality":
            scores = {r.doc_id: r.score for r in score(docs, fit(docs, spark.read.parquet(f"{TINY}/labels.parquet"))).collect()}
            assert after == {k: t for k, t in before.items() if scores[k] >= 0.7}
        elif name == "line_dedup":
            gone = {(x[0], x[1]) for x in brute_lines(list(before.items()))}
            assert gone == {(r.id, r.line) for r in duplicate_lines(docs).collect()}
            want = {k: [x for i, x in enumerate(t.split("\n")) if (k, i) not in gone] for k, t in before.items()}
            assert after == {k: "\n".join(x) for k, x in want.items() if any(y.strip() for y in x) or not any((k, i) in gone for i in range(len(before[k].split("\n"))))}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_dedup":
            assert after == {k: before[k] for k, _, c in brute_near(sorted(before.items())) if k == c}
            assert near_duplicates(docs).count() == len(before)
        else:
            leaked = {r.doc for r in find_leaks(docs, spark.read.parquet(f"{TINY}/benchmark.parquet")).collect()}
            assert after.keys() == before.keys() - leaked
        docs = out
    packed = corpus_pipeline.packing(spark, docs, TINY).collect()
    check(packed, {r.doc_id: r.text for r in docs.collect()})
    run = corpus_pipeline.run(spark, TINY)
    assert {(r.doc_id, r.start) for r in run.select("doc_id", "start").collect()} >= {(k, 0) for k in {r.doc_id for r in docs.collect()}}
    assert len(whole) > len(after)
