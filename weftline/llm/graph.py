"""Connected components of an undirected graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (columns a, b) the smallest node that it reaches.

    Each round takes over the smallest label among a node's neighbours and then the label of its label, so that rounds grow
    with the logarithm of a chain's length. Labels are saved after each round; nothing is collected.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:  # labels only fall, so that it ends
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        step = step.join(labels.select(F.col("node").alias("p"), F.col("component").alias("pc")), F.col("c") == F.col("p"), "left")
        new = saved(step.select("node", F.least("c", F.coalesce("pc", "c")).alias("component"), (F.least("c", F.coalesce("pc", "c")) != F.col("old")).alias("moved")))
        release(labels)
        if new.where("moved").limit(1).isEmpty():
            release(both)
            return new.select("node", "component")
        labels = new


class Sets:
    """Disjoint sets over 0..n-1 with the smallest member as name; for the few members of one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
