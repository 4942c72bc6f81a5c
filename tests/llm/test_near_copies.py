"""Near copies by shingles against brute force."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from millrace.llm import near_copies, simhash

from .conftest import words
from .test_dedup import roots


def brute_roots(rows, similarity=0.8):
    def cut(text):
        found = (text or "").encode().lower().split()
        return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()

    sets = [(i, cut(t)) for i, t in rows if i is not None]
    near = lambda a, b: a == b or len(a & b) / max(1, len(a | b)) >= similarity
    return roots({i for i, _ in sets}, [(i, j) for i, a in sets for j, b in sets if near(a, b)])


def planted():
    """Copies with 0 to 30 of 400 words changed: similarities from 1 over 0.8 to below."""
    rows = []
    for base in range(5):
        text = [f"{w}{k % 7}" for k, w in enumerate(words(base, 400).split())]
        for copy, changes in enumerate((0, 1, 4, 7, 8, 9, 10, 30)):
            changed = list(text)
            for k in range(changes):
                changed[11 * (k + 1)] = f"changed{copy}x{k}"
            rows.append((base * 10 + copy, " ".join(changed)))
    return rows


def test_stage_drops_planted_near_copies(spark):
    rows = planted()
    expected = brute_roots(rows)
    assert len(set(expected.values())) < len(rows) and expected[7] == 7 and expected[4] == 0
    kept = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected.values()))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = near_copies.near_duplicates(odd_docs).collect()
    root = brute_roots(odd_rows)
    assert Counter(tuple(r) for r in found) == Counter((i, root[i]) for i, _ in odd_rows if i is not None)
    assert near_copies.near_duplicates(no_docs).collect() == []


def test_given_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id: r.component_id for r in near_copies.near_duplicates(documents).collect()} == brute_roots(rows)


@pytest.mark.parametrize("most", [4, 300])
def test_large_groups_are_split(spark, monkeypatch, most):
    rows = planted()
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", most)
    found = near_copies.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_roots(rows)


def test_pairs_at_the_threshold_share_a_key():
    draw = np.random.default_rng(2)
    met = 0
    for _ in range(1000):
        some = draw.integers(0, 1 << 63, 100, np.uint64)
        met += bool((near_copies.keys_of(some[:90]) == near_copies.keys_of(some[10:])).any())
    assert met >= 998


def test_merged_joins_keep_the_same(spark, documents):
    ids = lambda kept: sorted((r.doc_id, r.text) for r in kept.collect())
    assert ids(near_copies.kept_documents(documents, few=0)) == ids(near_copies.kept_documents(documents))


def test_simhash_links_are_candidates(spark, monkeypatch):
    """Without minimum hashes, pairs within the fingerprints' distance are still found, and others aren't."""
    monkeypatch.setattr(near_copies, "candidates", lambda classes: classes.where("false").select(classes.cls.alias("u"), classes.cls.alias("v")))
    text = [f"{w}{k % 7}" for k, w in enumerate(words(3, 900).split())]
    rows = [(1, " ".join(text)), (2, " ".join(text[:-1])), (3, words(8, 300))]
    prints = [simhash.fingerprint(t, 5) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    found = near_copies.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3}


def test_ids_that_repeat_over_different_texts(spark):
    one, two, three = (words(k, 200) for k in (1, 2, 3))
    rows = [(1, one), (1, two), (1, two), (2, one), (2, three), (3, two), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for kept in (simhash.kept_documents(docs), corpus_pipeline.simhash_near_dedup(spark, docs, "")):
        assert Counter(map(tuple, kept.collect())) == Counter([(1, one), (1, two), (2, three), (None, one)])
