"""The pipeline: its stages' contracts, and the whole against its parts."""

from collections import Counter

import corpus_pipeline
from millrace.llm import langid, quality, secret_scan

from .test_near_copies import brute_roots


def test_stages_take_effect(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, ""), f"test-{name}")
        assert out.columns == documents.columns and dict(out.dtypes) == dict(documents.dtypes)
        before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, out))
        if name == "quality_rules":
            assert set(after) == {r.doc_id for r in quality.report(docs).where("kept").collect()}
        if name == "language_id":
            assert set(after) <= set(before) and len(after) >= 0.95 * len(before)
        if name == "simhash_near_dedup":
            assert set(after) == set(brute_roots([(r.doc_id, r.text) for r in before.values()]).values())
        if name == "secret_scans":
            assert set(after) == set(before)
            assert all(r.text == secret_scan.redact(before[i].text) and r.n_chars == len(r.text) for i, r in after.items())
            assert not any(secret_scan.spans(r.text)[0] for r in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    pieces = lambda rows: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert pieces(whole) == pieces(packed)


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    for given in (odd_docs, no_docs):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, ""), f"test-{name}")
            assert name == "best_fit_packing" or docs.columns == given.columns
        assert (docs.count() > 0) == (given is odd_docs)


def test_undetermined_languages_go(spark):
    rows = [(1, "12 34 56", "en"), (2, None, "en"), (3, "the cat and the dog were in the house", "en"), (4, "el gato y el perro en la casa", "es")]
    kept = langid.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.doc_id for r in kept.collect()} == {3, 4}
