"""Comparing the members of many groups of very unequal sizes, in blocks of bounded rows.

Rows of a group that holds more than `most` rows are dealt into blocks by hash, and each pair of blocks becomes a
group of its own; so no task holds more than two blocks of a group, and every pair of rows still meets once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a block; rows of a table of large groups up to which it is broadcast.
BLOCK_ROWS, BROADCAST_ROWS = 2048, 100_000


def blocked(rows: DataFrame, keys: list[str], spread: Column, most: int = BLOCK_ROWS, label: str = "groups") -> DataFrame:
    """rows with block, lo and hi, dealt and sorted by keys, lo and hi.

    A group of at most `most` rows has block = lo = hi = 0. Of a larger one, each row comes once for each block that
    its own meets: compare rows of block lo with those of block hi, or where they're one, all of its rows.
    """
    large = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).withColumn("_blocks", F.ceil(F.col("_n") / most).cast("int")).drop("_n"), label)
    n_large = large.count()
    if n_large:
        counted = rows.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, keys, "left")
        counted = counted.withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        counted = counted.withColumn("block", F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int"))
        counted = counted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        dealt = counted.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other", "_blocks")
    else:
        dealt = rows.withColumns({name: F.lit(0) for name in ("block", "lo", "hi")})
    by = [*keys, "lo", "hi"]
    return dealt.repartition(*by).sortWithinPartitions(*by)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows that end where a group ends, each with the starts of its groups and its length."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            value = table.column(key).to_numpy()
            new[1:] |= value[1:] != value[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
            held = table.slice(at[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(starts(table), table.num_rows)


def stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges (node, root) with the same components as the edges left-right."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]
