"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordframe.llm.common import materialize


HOT, HOTS = 100, 10_000


def _with_least(edges: DataFrame, least, n: int) -> DataFrame:
    """edges (a, b) with ``least`` of b by a, for n edges in all.

    A node with more than max(HOT, n / HOTS) edges has them where they are: of
    such nodes there are HOTS at most, so what is told of them is broadcast.
    The others meet their edges by a join.
    """
    most = max(HOT, n // HOTS)
    told = edges.groupBy("a").agg(least.alias("least"), F.count("*").alias("degree"))
    hot = F.broadcast(told.filter(F.col("degree") > most).drop("degree"))
    rest = edges.join(hot, "a", "left_anti").join(told.filter(F.col("degree") <= most).drop("degree"), "a")
    return edges.join(hot, "a").unionByName(rest)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node that it reaches.

    Alternating large-star and small-star steps; each round is written to the
    shared folder, so the lineage stays short.  The number of rounds grows with
    the logarithm of the longest path.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state, n = None, now.count()
    for _ in range(most_rounds):
        # Large star: each node sends its larger neighbours to its least one.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, F.least(F.min("b"), F.first("a")), 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        # Small star: each node sends itself and its smaller neighbours to the least of them.
        own = large.groupBy("a").agg(F.min("b").alias("b"))
        small = _with_least(large, F.min("b"), n).filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = materialize(small.unionByName(own).distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        state, n = seen, seen.n
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
