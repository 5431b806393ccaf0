"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.shared import cut


class Forest:
    """What links between n places of a task reach, as stars: a task need not yield all pairs of a dense group."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            part = a != b
            i, j, low, high = i[part], j[part], np.minimum(a, b)[part], np.maximum(a, b)[part]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root[:] = root[root]

    def connects(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """For pairs of ranges of places: whether all places of both reach one."""
        root = self.root
        steps = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
        return (steps[a1 - 1] == steps[a0]) & (steps[b1 - 1] == steps[b0]) & (root[a0] == root[b0])

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Each place that reaches a lesser one, with the least."""
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return moved, self.root[moved]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))  # a plain side, so that Spark can split a hub
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node that it reaches.

    Self links and repeated or turned edges make no difference; an empty table gives an empty one. Nulls are
    dropped. A hub's neighbours are never gathered: a round takes minima with map-side combining, then joins, so
    that the shuffle splits a hub. The number of rounds grows as the logarithm of the longest path; each is
    checkpointed.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = cut(_small_star(_large_star(edges)))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
