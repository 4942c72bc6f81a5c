"""Near-duplicates of texts and vectors, components and blocked groups against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import embed_dedup, grouped, simhash
from millrace.llm.components import components

from .conftest import words


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("links", [[], [(5, 5)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)] + [(100, 101), (101, 99), (3, 3)], [(7, 8), (7, 8), (8, 7)]])
def test_components(spark, links):
    found = components(spark.createDataFrame(links, "u long, v long")).collect()
    real = [(a, b) for a, b in links if a != b]
    expected = roots({n for link in real for n in link}, real)
    assert Counter((r.node, r.root) for r in found) == Counter(expected.items())


def test_components_of_random_graphs(spark):
    draw = random.Random(3)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)]
    found = components(spark.createDataFrame(links, "u long, v long")).collect()
    real = [(a, b) for a, b in links if a != b]
    assert {r.node: r.root for r in found} == roots({n for link in real for n in link}, real)


def test_stars_keep_components():
    draw = np.random.default_rng(1)
    left, right = draw.integers(0, 200, 150), draw.integers(0, 200, 150)
    u, v = grouped.stars(left, right)
    nodes = set(left.tolist()) | set(right.tolist())
    assert roots(nodes, zip(left.tolist(), right.tolist())) == roots(nodes, zip(u.tolist(), v.tolist()))


def test_blocks_let_each_pair_meet_once(spark):
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 100 + k) for k in range(3)], "g int, x long")
    met = Counter()
    for part in grouped.blocked(rows, ["g"], F.col("x"), most=8).rdd.glom().collect():
        groups = {}
        for r in part:
            groups.setdefault((r.g, r.lo, r.hi), []).append(r)
        for (g, lo, hi), some in groups.items():
            assert g == 1 or lo == hi == 0
            met.update((a.x, b.x) for a in some for b in some if a.x < b.x and (lo == hi or a.block != b.block))
    assert met == Counter((a, b) for s in (range(50), range(100, 103)) for a in s for b in s if a < b)


def test_fingerprints_and_components_over_odd_rows(odd_docs, odd_rows, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in odd_rows]
    named = [(i, f) for i, f in prints if i is not None]
    links = [(a, b) for a, f in named for b, g in named if (f ^ g).bit_count() <= 3]
    root = roots({i for i, _ in named}, links)
    assert Counter(tuple(r) for r in found) == Counter((i, f"{f:016x}", root.get(i)) for i, f in prints)
    assert simhash.near_duplicates(no_docs).collect() == []


def test_near_copies_meet(spark):
    rows = []
    for base in range(6):
        text = words(base, 400).split()
        for copy in range(5):
            changed = list(text)
            for k in range(copy):
                changed[37 * (k + 1)] = f"changed{copy}{k}"
            rows.append((base * 10 + copy, " ".join(changed)))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {r.doc_id: r.component_id for r in found} == roots(prints, links)
    kept = simhash.kept_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots(prints, links).values()))


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_links_lose_nothing(spark, distance):
    """Clustered fingerprints, every choice of partitions and thresholds, small blocks."""
    draw = random.Random(distance)
    values = set()
    for _ in range(8):
        centre = draw.getrandbits(64)
        values |= {centre ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(5))}) for _ in range(25)}
    values = sorted(values)
    classes = spark.createDataFrame([(simhash._signed(v), k) for k, v in enumerate(values)], "fp long, rep long")
    expected = roots(range(len(values)), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= distance])
    n, both = simhash.bit_counts(classes)
    assert n == len(values) and both[5, 5] == sum(v >> 5 & 1 for v in values) and both[5, 9] == sum(v >> 5 & v >> 9 & 1 for v in values)
    for m in {1, 2, distance + 1} if distance < 3 else {2, 3}:
        groups = simhash.partitions(n, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, thresholds = simhash.allocate(n, both, groups, distance)
        assert sum(thresholds) == distance - m + 1
        if max(thresholds) > 1:  # test_thresholds_above_one has these, with fewer fingerprints
            continue
        chosen = [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]
        found = simhash.links(classes, distance, chosen).collect()
        assert roots(range(len(values)), [(r.u, r.v) for r in found]) == expected


@pytest.mark.parametrize("distance,m", [(2, 1), (5, 2), (3, 2)])
def test_thresholds_above_one(spark, distance, m):
    draw = random.Random(distance + m)
    values = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        values |= {centre ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(5))}) for _ in range(6)}
    values = sorted(values)
    classes = spark.createDataFrame([(simhash._signed(v), k) for k, v in enumerate(values)], "fp long, rep long")
    groups = [list(range(k * 64 // m, (k + 1) * 64 // m)) for k in range(m)]
    thresholds = {(2, 1): [2], (5, 2): [2, 2], (3, 2): [2, 0]}[distance, m]
    assert sum(thresholds) == distance - m + 1
    found = simhash.links(classes, distance, list(zip(groups, thresholds))).collect()
    expected = roots(range(len(values)), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= distance])
    assert roots(range(len(values)), [(r.u, r.v) for r in found]) == expected


def test_unequal_thresholds_on_skewed_fingerprints(spark):
    """Thirty bits that seldom vary: their partitions tell little, and the plan that leaves them out loses no link."""
    draw = np.random.default_rng(12)
    bits = draw.random((20_000, 64)) < np.where(np.arange(64) < 30, 0.01, 0.5)
    values = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    near = values[:300] ^ (np.uint64(1) << draw.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 300).astype(np.uint64))
    values = np.unique(np.concatenate([values, near]))
    classes = spark.createDataFrame([(int(v), k) for k, v in enumerate(values.view(np.int64))], "fp long, rep long")
    n, both = simhash.bit_counts(classes)
    chosen = simhash.plan(n, both, 3)
    assert len({t for _, t in chosen}) > 1 or sum(len(g) for g, _ in chosen) < 64
    links = []
    for k in range(0, len(values), 500):
        a, b = np.nonzero(np.bitwise_count(values[k : k + 500, None] ^ values[None, :]) <= 3)
        links += [(int(x) + k, int(y)) for x, y in zip(a, b) if x + k != y]
    found = simhash.links(classes, 3, chosen).collect()
    assert roots(range(len(values)), [(r.u, r.v) for r in found]) == roots(range(len(values)), links)


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_are_estimated_where_bits_go_together(seed):
    """Sixteen bits in four groups of four that nearly agree: independence would be low by orders of magnitude."""
    draw = np.random.default_rng(seed)
    base = np.repeat(draw.random((6000, 4)) < 0.4, 4, axis=1) ^ (draw.random((6000, 16)) < 0.02)
    bits = np.zeros((6000, 64))
    bits[:, :16] = base
    both = bits.T @ bits
    some = bits[:, :16] @ (1 << np.arange(16))
    for threshold in (0, 1):
        differ = np.bitwise_count(some.astype(np.int64)[:, None] ^ some.astype(np.int64)[None, :])
        real = ((differ <= threshold).sum() - 6000) / 2
        assert 0.5 * real < simhash.candidates(6000, both, list(range(16)), threshold) < 2 * real


def test_hot_nodes_are_split(spark, monkeypatch):
    import millrace.llm.components as module

    monkeypatch.setattr(module, "HOT_EDGES", 5)
    draw = random.Random(6)
    links = [(0, k) for k in range(1, 200)] + [(500, 300 + k) for k in range(100)] + [(draw.randrange(600, 700), draw.randrange(600, 700)) for _ in range(90)]
    found = components(spark.createDataFrame(links, "u long, v long")).collect()
    real = [(a, b) for a, b in links if a != b]
    assert {r.node: r.root for r in found} == roots({n for link in real for n in link}, real)


def test_thresholds_follow_the_number_of_candidates():
    even = lambda n: np.full((64, 64), n / 4) + np.eye(64) * n / 4
    few, many = (simhash.plan(n, even(n), 3) for n in (10**4, 10**11))
    assert [t for _, t in few] == [0, 0, 0, 0] and sum(t + 1 for _, t in many) == 4 and max(t for _, t in many) > 0
    skewed = even(10**6)
    skewed[:24, :] *= 0.01
    skewed[:, :24] *= 0.01
    _, thresholds = simhash.allocate(10**6, skewed, [list(range(24)), list(range(24, 44)), list(range(44, 64))], 3)
    assert thresholds[0] == -1  # bits that hardly vary tell little


def brute_vectors(rows, least):
    usable = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a, u in usable for b, v in usable if a < b and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= least]
    counts = Counter(k for link in links for k in link)
    same = {}
    for k, (i, _) in enumerate(rows):  # rows of one id are one node
        links += [(k, same.setdefault(i, k))] if i is not None else []
    root = roots(range(len(rows)), links)
    least_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[root[k]] = min(i, least_id.get(root[k], i))
    found = [None if i is None else least_id[root[k]] for k, (i, _) in enumerate(rows)]
    return Counter((i, counts[k], found[k], i is not None and found[k] == i) for k, (i, _) in enumerate(rows))


def test_vectors(spark):
    draw = np.random.default_rng(4)
    rows = []
    for cluster in range(12):
        centre = draw.standard_normal(32)
        rows += [(cluster * 20 + k, (centre + 0.05 * k * draw.standard_normal(32)).tolist()) for k in range(10)]
    rows += [(900 + k, draw.standard_normal(32).tolist()) for k in range(60)]
    rows += [(500, rows[0][1]), (501, [2 * x for x in rows[0][1]]), rows[3], rows[3], (None, rows[15][1])]
    rows += [(700, None), (701, []), (702, [0.0] * 32), (703, [1.0, None] * 16), (704, [float("nan")] + [1.0] * 31), (705, [float("inf")] + [1.0] * 31), (706, [1.0, 2.0]), (707, [1.0, 2.1]), (708, [1e300] * 32), (709, [-0.0, 1.0] * 16), (710, [0.0, 1.0] * 16)]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, key int, n int").repartition(4)
    found = embed_dedup.near_duplicates(vectors).collect()
    assert Counter(tuple(r) for r in found) == brute_vectors(rows, 0.9)
    assert embed_dedup.near_duplicates(vectors.limit(0)).collect() == []


def test_ids_beyond_doubles_beside_null_ids(spark):
    draw = np.random.default_rng(8)
    centre = draw.standard_normal(16)
    rows = [(i, (centre + 0.01 * draw.standard_normal(16)).tolist()) for i in (2**53 + 1, 2**53 + 3, 2**53 + 5, None, -(2**60) - 1)]
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(tuple(r) for r in found) == brute_vectors(rows, 0.9)


def test_recall_over_embeddings(spark):
    """The query's own table against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = embed_dedup.near_duplicates(table).collect()
    assert Counter(tuple(r) for r in found) == brute_vectors(rows, 0.9)


@pytest.mark.parametrize("large", [50, 10**6])
def test_large_components_are_checked_by_buckets(spark, monkeypatch, large):
    draw = np.random.default_rng(11)
    centre = draw.standard_normal(16)
    rows = [(k, (centre + 0.1 * draw.standard_normal(16)).tolist()) for k in range(120)] + [(500 + k, draw.standard_normal(16).tolist()) for k in range(100)]
    monkeypatch.setattr(embed_dedup, "LARGE", large)
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    exact = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert Counter(tuple(r) for r in found.collect()) == brute_vectors(exact, 0.9)


def test_large_buckets_are_split(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centre = draw.standard_normal(16)
    rows = [(k, (centre + 0.08 * draw.standard_normal(16)).tolist()) for k in range(120)]
    monkeypatch.setattr(embed_dedup, "blocked", lambda rows, keys, spread, most=0, label="": grouped.blocked(rows, keys, spread, 25, label))
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(tuple(r) for r in found) == brute_vectors(rows, 0.9)


def test_shape_follows_the_chance_of_a_miss():
    for n in (10, 10**4, 10**6, 10**9):
        k, tables = embed_dedup.shape(n, 0.9)
        assert (1 - embed_dedup.collision(math.sqrt(0.2)) ** k) ** tables <= embed_dedup.MISS
    assert embed_dedup.shape(10**9, 0.9)[0] > embed_dedup.shape(10**4, 0.9)[0]


def test_sketches_lose_nothing():
    """Pairs just above the threshold stay candidates by their sketches, whatever the vectors look like."""
    draw = np.random.default_rng(9)
    for dims, spread in ((3, 1), (16, 1), (64, 1), (64, 30), (257, 100)):
        a = draw.standard_normal((4000, dims)) * np.where(draw.random((4000, dims)) < 0.1, spread, 1)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = draw.standard_normal((4000, dims))
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.9001 * a + math.sqrt(1 - 0.9001**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        form = embed_dedup.hasher(dims, 4, 2)
        (x, s), (y, t) = embed_dedup.unpacked(form.sketches(a)), embed_dedup.unpacked(form.sketches(b))
        assert ((x * y).sum(1) >= 0.9 - embed_dedup.SLACK / math.sqrt(12) * np.sqrt(s * s + t * t)).mean() > 0.9995


def test_recall_at_the_threshold():
    """Pairs just above 0.9 share a bucket about as often as they should."""
    draw = np.random.default_rng(6)
    k, tables = embed_dedup.shape(10**4, 0.9)
    hasher = embed_dedup.Hasher(64, k, tables)
    a = draw.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.standard_normal((3000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9005 * a + math.sqrt(1 - 0.9005**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = (hasher.codes(a) == hasher.codes(b)).any(1).mean()
    assert met >= 0.99
