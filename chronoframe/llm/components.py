"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch


def _mark(edges: DataFrame):
    """Count and order-free digest of an edge table."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the smallest node reachable.

    Self-loops and repeated edges do no harm; no edges: no rows. Both stars reduce each
    node's neighbours to the smallest by a partial aggregate, and the minima are kept as
    a table, so that the join that follows has a plain exchange on both sides, which
    adaptive execution splits where a hub has many neighbours.
    """
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    mark = _mark(now)
    while mark[0]:
        old = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.keep(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionByName(low2.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        mark = _mark(after)
        for t in (now, low, large, low2):
            scratch.drop(t)
        now = after
        if mark == old:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


class Forest:
    """Union-find whose roots are the smallest members; edges() spans what was joined."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple]:
        return [(x, self.find(x)) for x in list(self.up) if self.find(x) != x]
