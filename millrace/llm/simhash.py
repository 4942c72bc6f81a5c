"""SimHash fingerprints and near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most `distance` bits agree, in one of m partitions of the bits, up to that partition's
own threshold, if the thresholds sum to distance - m + 1 (a threshold of -1 leaves its partition out). Correlated
bits go to the same partition, and dynamic programming picks the thresholds, and with them m, that cost least by the
estimated number of candidates and of probes. Bit counts come from all distinct fingerprints. Each fingerprint is
filed under its value in every partition and probes all values within the threshold; candidates are verified.

Equal fingerprints are one class from the start, so copies are never compared. Large groups under one value are
split in blocks. A task emits, of the links it verifies, a forest with the same components, not the pairs.

Defined results: null and empty texts and those without words have fingerprint zero and link like any other; a
document without an id has its fingerprint and no component; repeated rows share class and component; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, hot_join, map_texts, text_hash, text_of, written
from .components import components
from .grouped import blocked, stars, whole_groups

BITS = 64
#: Words of a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Cost of a probe row against that of a verified candidate, for choosing thresholds.
PROBE_COST, CANDIDATE_COST = 1.0, 0.02
#: Pairs that are verified at a time; dropped documents up to which their ids are broadcast.
PAIRS, FEW = 1 << 20, 500_000


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles, repeats included; fewer words than a shingle has are one."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    join = b" ".join
    return np.fromiter((xxh64_intdigest(join(s), SEED) for s in zip(*(found[k:] for k in range(words)), strict=False)), np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's hashes: the bits that over half of them have; zero for none."""
    votes, raw = np.zeros(BITS, np.int64), hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for start in range(0, len(raw), 1 << 16):
        votes += np.unpackbits(raw[start : start + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The text's fingerprint, unsigned."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a signed long)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), text_hash(text_col).alias("text_hash"))

    def make(block: pa.RecordBatch) -> list[pa.Array]:
        found = np.array([fingerprint(t, words) for t in block.column("text").to_pylist()], np.uint64)
        return [block.column("doc_id"), block.column("text_hash"), pa.array(found.view(np.int64))]

    return map_texts(slim, make, "doc_id long, text_hash long, fp long")


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set; over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(values), 1 << 15):
                bits = ((values[k : k + (1 << 15), None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
                total += (bits.T @ bits).astype(np.int64)
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["k", "n"])

    rows = classes.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 64 x 64 + 1 sums
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for row in rows:
        flat[row.k] = row.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of about equal size: each group grows by the bit most correlated with its members."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [max(left, key=lambda b: (strength[b, list(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def candidates(n: int, both: np.ndarray, group: list[int], threshold: int) -> float:
    """Estimated pairs of n fingerprints that differ in at most threshold bits of group.

    Whether two fingerprints differ in a bit depends, here, on whether they differ in the bit before it, in an order
    in which each bit is followed by the one that goes with it most; the counts of pairs of bits say how much.
    """
    if threshold < 0:
        return 0.0
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)
    p11 = both / max(1, n)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    differ_both = 2 * (p11 * np.maximum(0, 1 - p11 - p10 - p01) + p10 * p01)
    rest, order = set(group[1:]), [group[0]]
    while rest:
        last = order[-1]
        order.append(max(rest, key=lambda b: (abs(differ_both[last, b] - differ[last] * differ[b]), -b)))
        rest.discard(order[-1])
    # chance[k, d]: that k bits so far differ, the last of them (d = 1) or not.
    chance = np.zeros((threshold + 2, 2))
    chance[0, 0], chance[1, 1] = 1 - differ[order[0]], differ[order[0]]
    for last, b in zip(order, order[1:]):
        after = differ_both[last, b] / differ[last] if differ[last] > 0 else differ[b]
        otherwise = (differ[b] - differ_both[last, b]) / (1 - differ[last]) if differ[last] < 1 else differ[b]
        new = np.zeros_like(chance)
        new[:, 0] = chance[:, 0] * (1 - otherwise) + chance[:, 1] * (1 - after)
        new[1:, 1] = chance[:-1, 0] * otherwise + chance[:-1, 1] * after
        new[-1] = 0.0
        chance = new
    return n * n / 2 * float(chance[: threshold + 1].sum())


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Least cost and the thresholds that have it; they sum to distance - m + 1."""
    goal = distance + 1  # thresholds plus one each sum to this
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        met = [candidates(n, both, group, t) for t in range(goal)]
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for extra in range(0, goal - used + 1):
                t = extra - 1
                probes = sum(comb(len(group), k) for k in range(t + 1))
                pairs = 2 * met[t] - met[0] if t >= 0 else 0.0  # a pair that differs is met by the probes of both
                total = cost + PROBE_COST * n * probes + CANDIDATE_COST * pairs
                if used + extra not in new or total < new[used + extra][0]:
                    new[used + extra] = (total, [*chosen, t])
        best = new
    return best[goal]


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use: the cheapest over the number of partitions."""
    options = []
    for m in range(1, min(BITS, 2 * distance + 2) + 1):
        groups = partitions(n, both, m)
        cost, thresholds = allocate(n, both, groups, distance)
        options.append((cost, m, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options)[2]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(classes: DataFrame, distance: int, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """Edges (u, v) between reps of classes (fp, rep) that have the components of all links within distance."""
    probes = []
    for part, (bits, threshold) in enumerate(chosen):
        mask = sum(1 << b for b in bits)
        for k in range(threshold + 1):
            for flipped in combinations(bits, k):
                probes.append((part, _signed(mask), _signed(sum(1 << b for b in flipped)), int(k > 0)))
    spark = classes.sparkSession
    table = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip"), F.lit(r).alias("role")) for p, m, f, r in probes]) if len(probes) <= 400 else None
    if table is not None:
        rows = classes.select("fp", "rep", F.explode(table).alias("p"))
    else:
        frame = spark.createDataFrame(probes, "part int, mask long, flip long, role int").select(F.struct("part", "mask", "flip", "role").alias("p")).agg(F.collect_list("p").alias("ps"))
        rows = classes.join(F.broadcast(frame)).select("fp", "rep", F.explode("ps").alias("p"))  # one row of probes
    rows = rows.select(F.col("p.part").alias("part"), F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("value"), F.col("p.role").alias("role"), "fp", "rep")
    dealt = blocked(rows, ["part", "value"], F.col("fp"), label="simhash-groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["part", "value", "lo", "hi"]):
            left, right = verified(table, at, distance)
            if len(left):
                u, v = stars(left, right)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def verified(table: pa.Table, at: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Reps of the linked pairs within the groups that start at `at`."""
    column = lambda name: table.column(name).to_numpy()
    role, block = column("role"), column("block")
    fp, rep = column("fp").view(np.uint64), column("rep")
    apart = column("lo") != column("hi")
    size = np.diff(at)
    group = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((block, role, group))
    filed = np.add.reduceat(role == 0, at[:-1]) if len(size) else size
    todo = np.flatnonzero((size > 1) & (filed > 0))
    left, right = [], []
    k = 0
    while k < len(todo):
        last, total = k, 0
        while last < len(todo) and (last == k or total + int(size[todo[last]]) * int(filed[todo[last]]) <= PAIRS):
            total += int(size[todo[last]]) * int(filed[todo[last]])
            last += 1
        some = todo[k:last]
        k = last
        count = size[some] * filed[some]
        which = np.repeat(np.arange(len(some)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        i = order[at[some][which] + offset // size[some][which]]
        j = order[at[some][which] + offset % size[some][which]]
        ok = (role[j] == 1) | (rep[i] < rep[j])
        ok &= (rep[i] != rep[j]) & (~apart[i] | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        left.append(rep[i[near]])
        right.append(rep[j[near]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least id reachable over links) of each document."""
    marked = written(fingerprints(docs, id_col, text_col, words), "simhash")
    classes = written(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-classes")
    n, both = bit_counts(classes)
    found = components(links(classes.drop("n"), distance, plan(n, both, distance)), "simhash-components")
    rooted = written(classes.join(found, classes.rep == found.node, "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id")), "simhash-rooted")
    for old in (classes, found):
        drop_written(old)
    joined = hot_join(marked, rooted, ["fp"], "n", F.struct("doc_id", "text_hash"), how="left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def kept_documents(docs: DataFrame, distance: int = 3, words: int = SHINGLE) -> DataFrame:
    """One document of each component of fingerprints: the one of the least id, with all its columns.

    Rows that repeat stay once; ids that repeat over different texts are told apart. Documents without an id are kept.
    """
    marked = written(fingerprints(docs, words=words).where("doc_id IS NOT NULL"), "simhash")
    classes = written(marked.select("fp", F.col("fp").alias("rep")).distinct(), "simhash-classes")
    n, both = bit_counts(classes)
    found = components(links(classes, distance, plan(n, both, distance)), "simhash-components")
    rooted = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("root"))
    return kept_of(docs, marked.join(rooted, "fp"))


def kept_of(docs: DataFrame, marked: DataFrame, few: int = FEW) -> DataFrame:
    """The document of the least id of each root in marked (doc_id, text_hash, root), once, and those without an id.

    Documents go by an anti-join with those dropped: broadcast if they are at most `few`, else merged.
    """
    rows = written(marked.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "simhash-rows")
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("k")).select("root", "k.*")
    dropped = written(rows.join(least.select("root", "doc_id", "text_hash"), ["root", "doc_id", "text_hash"], "left_anti").select("doc_id", F.col("text_hash").alias("_text_hash")), "simhash-dropped")
    gone = F.broadcast(dropped) if dropped.count() <= few else dropped.hint("merge")
    repeated = not least.where("n > 1").isEmpty()
    drop_written(rows)
    kept = docs.withColumn("_text_hash", text_hash("text")).join(gone, ["doc_id", "_text_hash"], "left_anti")
    if repeated:
        named = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "_text_hash"])
        kept = named.unionByName(kept.where("doc_id IS NULL"))
    return kept.select(*docs.columns)
