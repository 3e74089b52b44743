"""Connected components over edges of longs, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges (a, b) between n nodes to keep, so that they unite what all of them unite (fewer than n), and each
    node's group then."""
    label, left, kept = np.arange(n), np.arange(len(a)), []
    while len(left):
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            break
        # one edge for each label that has a lower neighbour, which then becomes one with it
        one, two = label[a[left]], label[b[left]]
        high, at = np.unique(np.maximum(one, two), return_index=True)
        kept.append(left[at])
        to = np.arange(n)
        to[high] = np.minimum(one, two)[at]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    return (np.concatenate(kept) if kept else np.zeros(0, np.int64)), label


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each larger neighbour of u goes to the least of u and its neighbours. Small star: u and its smaller neighbours do.

    The least neighbour comes from a partial aggregate, is written, and is joined back, so no neighbour list is ever
    gathered, and AQE can split the join of a hub.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        least = materialize(least, "least")
        out = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = down.join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select("m", "u"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node reachable; only nodes of an edge appear.

    edges: columns a, b (long, not null), any direction, repeats and loops allowed. An empty table gives an empty one.
    Each round is written to the shared folder, which bounds the lineage. Raises if it has not settled after `rounds`.
    """
    now = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        after = materialize(_star(_star(now, True), False), "edges")
        discard(now)
        now = after
        # Settled when every node has one parent, and no parent has a parent: a star for each component.
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(now.select("a", "a").distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
