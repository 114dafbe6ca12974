"""Connected components of a graph too large for one machine, by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches. Nodes are longs.

    Each round links nodes to the least node around them; a round's edges are a table, so lineage stays short. Joins are
    by node with its least neighbour, one row a node: a node with very many edges makes a large join partition, which
    Spark splits, and least neighbours are pre-aggregated.
    """
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.cut(small.select("e.u", "e.v").where("u <> v").distinct())
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Groups:
    """Connected groups of the rows of one task."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """Put others into the group of row i; gives one of them for each group that was another."""
        out = []
        for label in np.unique(self.label[others]).tolist():
            if label != self.label[i]:
                out.append(int(others[np.argmax(self.label[others] == label)]))
        for j in out:
            self.label[self.label == self.label[j]] = self.label[i]
        return out
