"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscat.operators.scale import salted_join
from corpuscat.session import cut_lineage


class Groups:
    """Union-find over a bounded number of items inside a task."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> bool:
        """Join two groups; False if they are one already."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _stars(edges: DataFrame, at: str, other: str) -> DataFrame:
    """Each edge with the smallest neighbour ``m`` of its end ``at``, that end included."""
    least = cut_lineage(edges.groupBy(at).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", at)))
    return salted_join(edges, least, at, "n", F.col(other))


def connected(links: DataFrame) -> DataFrame:
    """``id, component`` of all ids in ``links(a, b)``; the component is its smallest id.

    Alternating star steps: each id points its larger, then its smaller neighbours at its
    smallest one, until all edges point at roots. Every round is stored, so a lost executor
    costs one round, and the rounds grow with the logarithm of the longest chain. An id
    with very many links is dealt over salted parts. Links with a null end are left out.
    """
    ends = links.filter("a is not null and b is not null and a <> b")
    edges = cut_lineage(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        small = _stars(large, "u", "v")
        edges = cut_lineage(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
