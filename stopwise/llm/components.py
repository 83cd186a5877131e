"""Connected components of a distributed graph by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.workspace import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); the root is the smallest node.

    Every round hangs the larger neighbours of a node, then the smaller ones and the node itself,
    onto its smallest neighbour; it ends when the edges are stars. Each round's edges are written to
    the shared folder, so that no plan grows and a lost executor costs one round at most.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = staged(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("_a")).agg(F.min(F.least("a", "b")).alias("low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("_a"))
        large = large.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("low"))
        small = large.join(low, F.col("a") == F.col("_a")).select(
            F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("low").alias("b"),
        )
        now = staged(small.distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("b").alias("root")))
