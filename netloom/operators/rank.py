"""PageRank over multi-edges: reset 0.15, base r = 0.15 + 0.85 * sum r(u) / outdeg(u)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.graph import PropertyGraph
from netloom.plans.iterate import cut, discard


def pagerank(g: PropertyGraph, tol: float | None = 0.001, max_iter: int | None = None, reset: float = 0.15, normalize: bool = False) -> DataFrame:
    """(id, rank). Stops when no rank changes by more than ``tol``, or after ``max_iter`` rounds.

    Parallel edges are merged to weights first; each round is one join and one sum.
    ``normalize`` scales ranks to sum to the number of vertices.
    """
    merged = g.merged()
    out = merged.groupBy("src").agg(F.sum("n").alias("out"))
    weights = cut(merged.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("w")), "weights")
    ranks, k = cut(g.vertices.select("id", F.lit(1.0).alias("rank")), "ranks"), 0
    while max_iter is None or k < max_iter:
        sent = ranks.join(weights, ranks.id == weights.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        fresh = cut(ranks.join(sent, ranks.id == sent.dst, "left").select("id", (reset + (1 - reset) * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("was")), "ranks")
        k += 1
        discard(ranks)
        ranks = fresh.select("id", "rank")
        if tol is not None and (fresh.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) <= tol:
            break
    if normalize:
        sums = ranks.agg((F.count("*") / F.sum("rank")).alias("scale"))
        ranks = ranks.crossJoin(F.broadcast(sums)).select("id", (F.col("rank") * F.col("scale")).alias("rank"))  # one row
    return ranks


def pagerank_step(g: PropertyGraph) -> DataFrame:
    """(id, rank) after one undirected step from 1/N each."""
    both = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.*")
    out = both.groupBy("a").agg(F.count("*").alias("deg"))
    sums = both.join(out, "a").groupBy(F.col("b").alias("id")).agg(F.sum(1.0 / F.col("deg")).alias("s"))
    n = g.vertices.agg(F.count("*").alias("n"))
    return g.vertices.join(sums, "id", "left").crossJoin(F.broadcast(n)).select("id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("rank"))  # one row
