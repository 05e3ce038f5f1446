"""Connected components by alternating large and small stars over narrow edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.tables import stored


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Tie the larger (or the smaller) neighbours of every node to the least of its neighbours and itself."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = pairs.join(least, "u")
    if larger:
        return tied.where("v > u AND v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    rows = tied.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("p"))
    return rows.select("p.a", "p.b").where("a != b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that an edge ties to another; the root is the least node reachable.

    Nodes are integers, ties and repeated edges do no harm, an empty table gives an empty result. Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        ends = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = stored(_star(ends, False), "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
        seen = mark
