"""Connected components of a graph too large for one machine, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, hot_join, stands_for, written

#: Edges of a node that one task joins at most, and nodes with more of them at most (else the first number grows).
HOT_EDGES, HOT_NODES = 1 << 16, 50_000


def _with_least(edges: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with m, the least v of u; and u and m of each u.

    The edges of a node that has more than HOT_EDGES are split by hash over several keys of the join, and its least
    neighbour goes to each. There are at most HOT_NODES such nodes, and none where there are no more edges than that.
    """
    most = max(HOT_EDGES, 2 * n_edges // HOT_NODES)
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if n_edges <= most:
        return edges.join(least.select("u", "m"), "u"), least
    least = written(least, "components-least")
    return hot_join(edges, least, ["u"], "n", F.col("v"), most).drop("n"), least


def _large_star(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met, least = _with_least(both, 2 * n)
    return met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), least


def _small_star(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met, least = _with_least(down, n)
    return met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))), least


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node and root (the least node reachable) for each node of edges (u, v); nodes are longs.

    Every step is a minimum by node and a join, so no task holds a component; each round is written in the shared
    folder, and the one before it deleted. Rounds grow with the logarithm of the nodes. Self-loops and repeated
    edges are dropped; a graph without edges has no rows. drop_written() deletes what the result reads.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    state = _state(now)
    while state[0]:
        large, first = _large_star(now, state[0])
        if state[0] > HOT_EDGES:
            large = written(large.distinct(), label)
        small, second = _small_star(large, state[0])
        new = written(small.distinct(), label)
        for old in (now, first, large, second):
            drop_written(old)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return stands_for(found, now)
