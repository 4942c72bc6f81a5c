"""SimHash near-duplicates for word shingles of a given similarity, checked exactly: what the pipeline's stage calls.

The candidates are, first, the links of operator 4: fingerprints of the shingles that the generalised pigeonhole finds
within `distance` bits. A pair at a Jaccard similarity of 0.8 differs in about 10 of 64 bits, and an index for the 18
that hold nearly all such pairs has no selective keys, so fingerprints alone would lose them. Therefore each class of
equal sets also has TABLES keys of ROWS minimum hashes, and classes that share a key are candidates too. All
candidates are compared within their connected components, each set shipped once to its component (large ones split
in blocks), and linked by the exact similarity of their sets. A pair shares no key with a chance of
(1 - s ** ROWS) ** TABLES at similarity s: under 0.0001 at 0.8, under 1e-11 at 0.9.

Defined results: null and empty texts and those without words are copies of each other; a text of fewer words than a
shingle is one shingle; a document without an id is kept and near to none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, hot_join, map_texts, text_hash, text_of, written
from .components import components
from .grouped import blocked, stars, whole_groups
from .simhash import FEW, bit_counts, kept_of, majority, plan, shingle_hashes
from .simhash import links as fingerprint_links

SEED = 42
#: Minimum hashes of a key, and keys of a class.
ROWS, TABLES = 7, 40
#: Classes of a candidate component that are compared at a time (twice as many between two blocks), and shingles.
BLOCK_ROWS, COLUMNS = 256, 8192

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 63, ROWS * TABLES, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _draw.integers(0, 1 << 63, ROWS * TABLES, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(shingle_hashes(text, words))


def keys_of(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles, signed; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * TABLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (_FACTORS[:, None] * found[None, at : at + 1024] + _TERMS[:, None]).min(1), out=least)
    return np.array([xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(TABLES, ROWS))], np.uint64).view(np.int64)


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (u, v) from each class (cls, keys) to the least class that shares a key; keys that many share are split."""
    rows = classes.select("cls", F.explode("keys").alias("key"))
    shared = written(rows.groupBy("key").agg(F.min("cls").alias("least"), F.count("*").alias("n")).where("n > 1"), "near-copies-keys")
    return hot_join(rows, shared, ["key"], "n", F.col("cls")).where("cls != least").select(F.col("cls").alias("u"), F.col("least").alias("v"))


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets that are similar enough."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, int(column[j - 1]) - start + 1)), np.float32)
        dense[row[i:j], column[i:j] - start] = 1
        both += (dense @ dense.T).astype(np.int64)
    left, right = np.nonzero(np.triu(both, 1))
    inside = both[left, right]
    near = inside / (size[left] + size[right] - inside) >= similarity
    return left[near], right[near]


def links(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) that have the components of all links between sets (root, cls, shingles) of one root."""
    dealt = blocked(sets, ["root"], F.col("cls"), BLOCK_ROWS, "near-copies-groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["root", "lo", "hi"]):
            cls, block = table.column("cls").to_numpy(), table.column("block").to_numpy()
            apart = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            column = table.column("shingles").combine_chunks()
            values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            for i, j in zip(at, at[1:]):
                if j - i < 2:
                    continue
                left, right = similar([values[ends[k] : ends[k + 1]] for k in range(i, j)], similarity)
                left, right = left + i, right + i
                if apart[i]:
                    met = block[left] != block[right]
                    left, right = left[met], right[met]
                if len(left):
                    u, v = stars(cls[left], cls[right])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def marked_documents(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (fingerprint), cls (a hash of the set of shingles) and keys of each document."""
    from xxhash import xxh64_intdigest

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), text_hash(text_col).alias("text_hash"))

    def make(block: pa.RecordBatch) -> list[pa.Array]:
        found = [shingle_hashes(t, words) for t in block.column("text").to_pylist()]
        prints = np.array([majority(f) for f in found], np.uint64).view(np.int64)
        sets = list(map(np.unique, found))
        cls = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        keys = [keys_of(s) for s in sets]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        return [block.column("doc_id"), block.column("text_hash"), pa.array(prints), pa.array(cls), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))]

    return map_texts(slim, make, "doc_id long, text_hash long, fp long, cls long, keys array<long>")


def simhash_candidates(marked: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) between classes (cls, fp) whose fingerprints differ in at most distance bits."""
    prints = marked.select("cls", "fp").distinct()
    classes = written(prints.groupBy("fp").agg(F.min("cls").alias("rep")), "near-copies-prints")
    n, both = bit_counts(classes)
    same = prints.join(classes, "fp").where("cls != rep").select(F.col("cls").alias("u"), F.col("rep").alias("v"))
    return same.union(fingerprint_links(classes, distance, plan(n, both, distance)))


def rooted_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 3, few: int = FEW) -> DataFrame:
    """doc_id, text_hash and root (the same for all of a component) of each document with an id.

    The texts of candidates are found by a join with their ids: broadcast if they are at most `few`, else merged.
    """
    marked = written(marked_documents(docs, words).where("doc_id IS NOT NULL"), "near-copies")
    least = F.min(F.struct("doc_id", "text_hash")).alias("k")
    classes = written(marked.groupBy("cls").agg(least, F.first("keys").alias("keys")).select("cls", "k.*", "keys"), "near-copies-classes")
    grouped = components(candidates(classes).union(simhash_candidates(marked, distance)), "near-copies-candidates")
    wanted = written(classes.select("cls", "doc_id", "text_hash").join(grouped, F.col("cls") == F.col("node")).select("cls", "doc_id", "text_hash", "root"), "near-copies-wanted")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), text_hash("text").alias("text_hash"))
    met = F.broadcast(wanted) if wanted.count() <= few else wanted.hint("merge")
    texts = slim.join(met, ["doc_id", "text_hash"]).select("cls", "root", "text")

    def make(block: pa.RecordBatch) -> list[pa.Array]:
        found = [shingles(t, words) for t in block.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return [block.column("cls"), block.column("root"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))]

    sets = written(map_texts(texts, make, "cls long, root long, shingles array<long>").dropDuplicates(["cls"]), "near-copies-sets")
    found = components(links(sets, similarity), "near-copies-components")
    for old in (classes, grouped, wanted, sets):
        drop_written(old)
    return marked.join(found, F.col("cls") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "cls").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 3) -> DataFrame:
    """doc_id and component_id (the least id of the component) of each document with an id."""
    rooted = written(rooted_documents(docs, words, similarity, distance), "near-copies-rooted")
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(named, "root").select("doc_id", "component_id")


def kept_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 3, few: int = FEW) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id, with all columns.

    Rows that repeat stay once; ids that repeat over different texts are told apart. Documents without an id are kept.
    Null, empty and wordless texts are one group; an empty table stays empty.
    """
    return kept_of(docs, rooted_documents(docs, words, similarity, distance, few), few)
