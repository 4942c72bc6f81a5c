"""Token counts, byte-level merges, ORC token files and packing against the tokenizers' own libraries."""

import functools
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from millrace.llm import byte_bpe, chunks, orc_tokens, packing, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdethHTJ.,!  \n\t'sé日😀▁<>0x41!\xa0́"


@pytest.fixture(scope="module")
def unigram():
    vocabulary = token_counts.read_vocabulary(PIECES)
    out = Tokenizer(models.Unigram([tuple(v) for v in vocabulary], 0, True))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return token_counts.UnigramCounter(vocabulary), out


@pytest.fixture(scope="module")
def merges():
    ranks = byte_bpe.read_ranks(RANKS)
    return byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


#: All of Unicode, and what cuts, folds, composes or is an added token.
UNICODE = st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([*ALPHABET, "\u0130", "I", "\u0307", "\u0331", "K", "\u017f", "\x01", "\x1c", "\u200b", "\u3000", "\r", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"])), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_unigram_counts_equal_the_library(unigram, text):
    counter, tokenizer = unigram
    assert counter.count_texts([text, None, "", text + " x"])[0].tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, "", "", text + " x")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(ALPHABET.replace(" ", "q").replace("▁", "z"), max_size=30), max_size=12))
def test_words_together_count_as_alone(unigram, words):
    counter, _ = unigram
    marked = [token_counts.BLANK + w for w in words]
    assert counter.count_words(marked) == [counter.count(w) for w in marked]


def test_words_with_signs_are_sums_only_where_that_is_exact(unigram):
    counter, tokenizer = unigram
    assert counter.parted
    for text in ("the. cat, sat!? on$$$ the&&& mat*** ñandú. é; ß: ö? ÿ%%", "a.b .c d.. ..", "ǆ. x. ﬁ, 日本。 日."):
        assert counter.count_texts([text])[0].tolist() == [len(tokenizer.encode(text, add_special_tokens=False).ids)]
    signs = [(c, -1.0) for c in token_counts.SIGNS]
    base = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), *signs]
    assert token_counts.UnigramCounter(base, 0, False).parted
    assert not token_counts.UnigramCounter([*base, ("a.", -1.0)], 0, False).parted
    assert not token_counts.UnigramCounter([*base, ("ba", -1.5)], 0, False).parted
    assert not token_counts.UnigramCounter(base[:-1], 0, False).parted


def test_random_vocabularies_with_ties():
    """Small integer scores make many ties; words of all lengths, together and alone, against the library."""
    draw = random.Random(11)
    for _ in range(30):
        pieces = list({"".join(draw.choices("abc▁", k=draw.randint(1, 4))) for _ in range(25)})
        vocabulary = [("<unk>", 0.0), *((p, -float(draw.randint(1, 4))) for p in [*pieces, *token_counts.SIGNS, "..", "!?!"])]
        tokenizer = Tokenizer(models.Unigram(vocabulary, 0, False))
        tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
        counter = token_counts.UnigramCounter(vocabulary, 0, False)
        texts = [" ".join("".join(draw.choices("abcd", k=draw.randint(0, 80))) + "".join(draw.choices(".!?", k=draw.randint(0, 4))) for _ in range(draw.randint(1, 6))) for _ in range(20)]
        assert counter.count_texts(texts)[0].tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_unigram_ties_take_the_longer_piece():
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bc", -2.0), ("c", -1.0), ("abc", -3.0), ("▁", -1.0)]
    tokenizer = Tokenizer(models.Unigram(vocabulary, 0, False))
    counter = token_counts.UnigramCounter(vocabulary, 0, False)
    for word in ("abc", "abab", "zzabczz", "cba", "abcabcab", "z"):
        assert counter.count(word)[0] == len(tokenizer.encode(word).ids)
    assert counter.count("abc") == (1, -3.0)


def test_token_counts_over_odd_rows(unigram, odd_docs, odd_rows, no_docs):
    _, tokenizer = unigram
    found = token_counts.token_counts(odd_docs, PIECES).collect()
    expected = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows)
    assert Counter((r.doc_id, r.n_tokens) for r in found) == expected
    assert token_counts.token_counts(no_docs, PIECES).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=80))
def test_merges_equal_the_library(merges, text):
    own, encoding = merges
    ids, offsets = own.encode([text, "", text])
    assert ids.tolist() == encoding.encode_ordinary(text) * 2 and offsets.tolist() == [0, len(ids) // 2, len(ids) // 2, len(ids)]
    assert own.decode(ids) == (text * 2).encode()


def test_long_matches_merge_the_same(merges):
    own, encoding = merges
    draw = random.Random(5)
    for text in ("a" * 5000, "".join(draw.choices("abcdefgh", k=4000)), " " * 700 + "x", "=" * 999, "日本語の文字" * 200, "ab" * 100_000):
        assert own.encode([text])[0].tolist() == encoding.encode_ordinary(text)


def brute_merges(ranks, raw):
    """One merge a round: the leftmost pair of least rank."""
    parts = [raw[k : k + 1] for k in range(len(raw))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merges_where_a_merge_makes_a_pair_of_less_rank(tmp_path):
    import base64

    draw = random.Random(9)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        more = list({bytes(draw.choices(b"abc", k=draw.randint(2, 5))) for _ in range(25)})
        draw.shuffle(more)  # ranks that no training would give
        path = tmp_path / "ranks"
        path.write_bytes(b"".join(base64.b64encode(t) + f" {k}\n".encode() for k, t in enumerate([*tokens, *more])))
        own, ranks = byte_bpe.ByteBpe(str(path), public_tokenizers.PATTERN), byte_bpe.read_ranks(path)
        raw = [bytes(draw.choices(b"abc", k=draw.randint(1, 40))) for _ in range(40)]
        assert [np.frombuffer(f, "<u4").tolist() for f in own.merge_all(raw)] == [brute_merges(ranks, r) for r in raw]


def test_digests_over_odd_rows(merges, odd_docs, odd_rows, no_docs):
    _, encoding = merges
    found = byte_bpe.digests(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    expected = Counter()
    for i, t in odd_rows:
        ids = encoding.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in found) == expected
    assert byte_bpe.digests(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []
    back = byte_bpe.decode(byte_bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.raw)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in odd_rows)


def check_ids(texts):
    for path, kind in ((BYTES, "spaced"), (WORDS, "folded")):
        ids, offsets = chunks.shared_encoder(path, kind).encode(texts)
        expected = library(path).encode_batch(texts, add_special_tokens=False)
        assert [ids[i:j].tolist() for i, j in zip(offsets, offsets[1:])] == [e.ids for e in expected]


@settings(max_examples=400, deadline=None)
@given(st.lists(UNICODE, min_size=1, max_size=4))
def test_ids_equal_the_plain_library_call(texts):
    check_ids(texts)


def test_ids_of_known_snares():
    check_ids(["İ, x", "TÜRKİ. evet", "AYŞE VE ALİ; EV", "a <|endoftext|> b", "a\n <|endoftext|>", "<|ENDOFTEXT|> x", "x<|startoftext|>", "a \x01b", "a\n\x01b", "H̱ I̱. K̇", "\n", " ", "a\nb\n", "a\r\nb c", ""])


def test_recent_forgets_rare_strings_only():
    from millrace.llm.common import Recent

    made = []
    recent = Recent(10)
    for k in range(30):
        recent.resolve({"often", f"rare{k}"}, lambda new: made.extend(new) or [n.upper() for n in new])
    assert made.count("often") == 1 and len(recent.young) + len(recent.old) <= 12
    recent.resolve({"x" * 100}, lambda new: ["y"])
    assert "x" * 100 not in recent.young
    assert recent.resolve({"often", "new"}, lambda new: [n.upper() for n in new]) == {"often": "OFTEN", "new": "NEW"}


def test_token_files(spark, tmp_path, odd_docs, odd_rows, no_docs):
    folder = f"file://{tmp_path}/orc"
    orc_tokens.write_tokens(odd_docs, folder, BYTES, parts=4)
    tokenizer = library(BYTES)
    coded = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in odd_rows}
    found = orc_tokens.summary(spark, folder).collect()
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, start = [], 0
    for i, t in ordered:
        expected.append((i, start, len(coded[t]), zlib.crc32(np.array(coded[t], "<u4").tobytes())))
        start += len(coded[t])
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    hit = orc_tokens.lookup(spark, folder, [101, 5])
    assert {r.doc_id: r.ids for r in hit.collect()} == {i: coded[t] for i, t in odd_rows if i in (5, 101)}
    assert "PushedFilters: [In(doc_id, [5,101])]" in hit._jdf.queryExecution().toString() or "In(doc_id" in hit._jdf.queryExecution().toString()
    orc_tokens.write_tokens(no_docs, f"{folder}-none", BYTES)
    assert orc_tokens.summary(spark, f"{folder}-none").collect() == []


def test_token_files_have_indexes_that_skip_rows(spark, tmp_path):
    """The footers hold row indexes and Bloom filters, and a lookup's scan gives out only row groups that may hold the ids."""
    folder = f"file://{tmp_path}/orc"
    docs = spark.range(30_000).selectExpr("id * 3 AS doc_id", "concat('text ', id) AS text")
    orc_tokens.write_tokens(docs, folder, BYTES, parts=1)
    hit = orc_tokens.lookup(spark, folder, [3 * 101, 3 * 15_000, 7])
    assert sorted(r.doc_id for r in hit.collect()) == [303, 45_000]
    leaves, scanned = hit._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        scanned += leaves.apply(k).metrics().apply("numOutputRows").value()
    assert 2 <= scanned <= 4 * int(orc_tokens.ORC_OPTIONS["orc.row.index.stride"])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in hit.inputFiles():
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        for stripe in reader.getStripes():
            kinds = {str(stream.getKind()) for stream in rows.readStripeFooter(stripe).getStreamsList()}
            assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def check_packing(rows, lengths, capacity):
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
        assert 0 < r.length <= capacity and r.start == r.piece * capacity
    assert by_doc == lengths
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_odd_rows(odd_docs, odd_rows, no_docs):
    tokenizer = library(WORDS)
    coded = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in odd_rows]
    found = packing.pack_documents(odd_docs, WORDS, capacity=256).collect()
    lengths = Counter()
    for i, ids in coded:
        lengths[i] += len(ids)
    n = check_packing(found, lengths, 256)
    assert n <= -(-sum(lengths.values()) // 256) + 1
    expected = Counter((i, k // 256, zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for i, ids in coded for k in range(0, len(ids), 256))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in found) == expected
    assert packing.pack_documents(no_docs, WORDS).collect() == []


def brute_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed,low,high,block", [(1, 1, 100, 3000), (2, 30, 60, packing.BLOCK_TOKENS), (3, 1, 12, 3000), (4, 51, 100, packing.BLOCK_TOKENS), (5, 34, 34, packing.BLOCK_TOKENS), (6, 1, 40, packing.BLOCK_TOKENS)])
def test_packing_is_as_good_as_best_fit(spark, seed, low, high, block):
    draw = random.Random(seed)
    lengths = [draw.randint(low, high) for _ in range(2000)]
    found = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    n = check_packing(packing.pack(found, 100, block).collect(), Counter(dict(enumerate(lengths))), 100)
    assert n <= brute_best_fit(lengths, 100) * 1.02 + 8


def test_claims_meet_once():
    draw = random.Random(3)
    for _ in range(200):
        pieces, gaps = ({k: draw.randint(1, 50) for k in range(12) if draw.random() < 0.6} for _ in range(2))
        found = packing.claims(pieces, gaps)
        for number, total in pieces.items():
            parts = sorted((at, n) for r, at, n, _, _ in found if r == number)
            assert [at for at, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == total
        taken = Counter()
        for number, _, n, other, there in found:
            assert n > 0 and (other is None or (other < number and there >= 0 and there + n <= gaps[other]))
            for token in range(there, there + n) if other is not None else ():
                taken[other, token] += 1
        assert not taken or max(taken.values()) == 1
        for number, _, _, other, _ in found:  # new sequences only where no range before has a gap left
            assert other is not None or all(taken[r, t] for r in gaps if r < number for t in range(gaps[r]))


def test_recent_forgets_at_another_stage(monkeypatch):
    import pyspark

    from millrace.llm.common import Recent

    class Task:
        def __init__(self, stage):
            self.stageId = lambda: stage

    one, two = Recent(), Recent()
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: Task(1))
    one.resolve({"a"}, lambda new: new)
    two.resolve({"b"}, lambda new: new)
    assert one.young and two.young
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: Task(2))
    two.resolve({"c"}, lambda new: new)
    assert not one.young and set(two.young) == {"b", "c"}
