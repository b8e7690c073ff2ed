"""Connected components by alternating large-star and small-star rounds.

Every round replaces edges by as many edges or fewer; a node with many neighbours is
handled by a minimum (summed on the map side) and a join back, never as one list. Each
round is written to the shared folder, and the one before deleted. Rounds grow with the
logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import drop_table, shared_table, skew_join


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = shared_table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
    return skew_join(both.where("b > a"), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = shared_table(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    moved = skew_join(down, least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b): root is the smallest node that it reaches.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    A star of any size is one broadcast minimum (see skew_join).
    """
    now = shared_table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        large = shared_table(_large_star(now), "large")
        drop_table(now)
        now = shared_table(_small_star(large), "small")
        drop_table(large)
        fresh = mark(now)
        if fresh == seen:
            break
        seen = fresh
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
