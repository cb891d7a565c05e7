"""Connected components of a table of links, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import cut, discard


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b): every node moves to the least neighbour known."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # a table of its own, so that the join deals both sides anew and can split the edges of a hub
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    lower = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    small = large.join(lower, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node in ``links``: root is the smallest node that links reach, the node itself included.

    Alternates large and small stars over a table that never has more rows than there are links; groups of any size
    are aggregated before they are shuffled, and each round's table is written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    state, seen = cut(edges), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen, old = now, state
        state = cut(_stars(old))
        discard(old)
    # when nothing moves any more, each node but a root has one edge, to its root
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b"), F.col("b")).distinct())
