"""Breadth-first search, shortest paths, closeness.

One frontier loop serves all targets at once: each level is one join of the frontier
with the links and an anti-join with what is known, written to the shared folder.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import reach
from netloom.plans.graph import PropertyGraph
from netloom.plans.iterate import cut, discard, place

BLOCK = 100_000
IN_MEMORY, PAIRS = 8_000_000, 100_000_000


def sssp(g: PropertyGraph, source: int, directed: bool = True, until: int | None = None, cutoff: int | None = None) -> DataFrame:
    """(id, dist, parent) of every vertex that ``source`` reaches; of equal parents the smallest.

    Stops early once ``until`` is reached, or after ``cutoff`` levels. An unknown source
    gives no rows.
    """
    links = cut(g.simple() if directed else g.undirected(), "links")
    frontier = cut(g.vertices.where(F.col("id") == source).select("id", F.lit(0).alias("dist"), F.lit(None).cast("long").alias("parent")).distinct(), "level")
    levels = [frontier]
    while not frontier.isEmpty() and (cutoff is None or len(levels) <= cutoff):
        known = reduce(DataFrame.unionByName, levels).select("id")
        step = frontier.join(links, frontier.id == links.src).groupBy("dst").agg(F.min("src").alias("parent"))
        step = step.join(known, step.dst == known.id, "left_anti")
        frontier = cut(step.select(F.col("dst").alias("id"), F.lit(len(levels)).alias("dist"), "parent"), "level")
        levels.append(frontier)
        if until is not None and not frontier.where(F.col("id") == until).isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def bfs(g: PropertyGraph, source: int, target: int, directed: bool = True) -> DataFrame:
    """(step, id) of one shortest path; no rows if there is none or both ends are one."""
    spark = g.edges.sparkSession
    empty = spark.createDataFrame([], "step int, id long")
    if source == target:
        return empty
    tree = cut(sssp(g, source, directed, until=target), "tree")
    path, at = [], target
    while at is not None:  # one lookup a step of the path
        row = tree.where(F.col("id") == at).select("dist", "parent").first()
        if row is None:
            return empty
        path.append((row["dist"], at))
        at = row["parent"]
    return spark.createDataFrame(path[::-1], "step int, id long")


def closeness(g: PropertyGraph, vertex: int, directed: bool = True) -> DataFrame:
    """(closeness): all vertices over the sum of distances; -1 if nothing is reached."""
    total = sssp(g, vertex, directed).where("dist > 0").agg(F.sum("dist").alias("s"))
    return total.crossJoin(g.vertices.agg(F.count("*").alias("n"))).select(F.when(F.col("s") > 0, F.col("n") / F.col("s")).otherwise(F.lit(-1.0)).alias("closeness"))  # one row each


def harmonic_closeness(g: PropertyGraph, hops: int | None = 1, block: int = BLOCK) -> DataFrame:
    """(id, closeness): the sum of 1/dist over what a vertex reaches undirected within ``hops``, all of it if None.

    Vertices that reach none are left out. All that is reached is counted in memory by
    :mod:`netloom.operators.reach`, while the links both ways are ``IN_MEMORY`` at most.
    Otherwise sources go in blocks of about ``block``, or of fewer without a bound on hops,
    so that about ``PAIRS`` pairs at most are on disk at a time; a block's pairs are deleted
    once summed.
    """
    if hops == 1:
        return g.undirected().groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("closeness"))
    links = cut(g.undirected(), "links")
    if hops is None:
        if links.count() <= IN_MEMORY:
            sums = reach.harmonic(links)
            discard(links)
            return sums
        block = min(block, max(1, PAIRS // g.vertices.count()))
    spark, folder = links.sparkSession, place(links.sparkSession, "closeness")
    for k, sources in enumerate(_blocks(g, block)):
        pairs = _distances(links, sources, hops, counted=False)
        pairs.where("dist > 0").groupBy(F.col("s").alias("id")).agg(F.sum(1.0 / F.col("dist")).alias("closeness")).write.parquet(f"{folder}/block={k}")
        discard(pairs)
    return spark.read.schema("id long, closeness double").parquet(folder).select("id", "closeness")


def _blocks(g: PropertyGraph, block: int) -> list[DataFrame]:
    """The vertices (id) in parts of about ``block``."""
    n = max(1, -(-g.vertices.count() // block))
    return [g.vertices.select("id").where(F.pmod(F.xxhash64("id"), F.lit(n)) == k) for k in range(n)]


def all_distances(g: PropertyGraph, hops: int, directed: bool = True) -> DataFrame:
    """(s, v, dist, paths) of all pairs within ``hops``; paths counts shortest ones."""
    return _distances(cut(g.simple() if directed else g.undirected(), "links"), g.vertices, hops)


def _distances(links: DataFrame, sources: DataFrame, hops: int | None, counted: bool = True) -> DataFrame:
    """(s, v, dist, paths) from some sources; paths is 1 unless ``counted``, as numbers of paths may outgrow a long."""
    total = F.sum("paths") if counted else F.first("paths")
    frontier = cut(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("dist"), F.lit(1).cast("long").alias("paths")), "level")
    levels = [frontier]
    for d in count(1):
        if hops is not None and d > hops:
            break
        known = reduce(DataFrame.unionByName, levels).select("s", F.col("v").alias("dst"))
        step = frontier.join(links, frontier.v == links.src).groupBy("s", "dst").agg(total.alias("paths")).join(known, ["s", "dst"], "left_anti")
        frontier = cut(step.select("s", F.col("dst").alias("v"), F.lit(d).alias("dist"), "paths"), "level")
        levels.append(frontier)
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def betweenness(g: PropertyGraph, hops: int, block: int = BLOCK) -> DataFrame:
    """(id, bc): over ordered pairs within ``hops`` on the simple undirected graph, each vertex's share of shortest paths.

    Sources go in blocks of about ``block``, so that the pairs on disk at a time grow
    with a block's reach and not with that of all vertices.
    """
    if hops < 1:
        raise ValueError("hops must be positive")
    links = cut(g.undirected(), "links")
    parts = [cut(_shares(links, sources, hops), "shares") for sources in _blocks(g, block)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("bc").alias("bc"))
    return g.vertices.join(sums, "id", "left").select("id", F.coalesce("bc", F.lit(0.0)).alias("bc"))


def _shares(links: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(id, bc) over the pairs of some sources."""
    pairs = cut(_distances(links, sources, hops), "pairs")
    below = pairs.where(F.col("dist") == hops).select("s", "v", "paths", F.lit(0.0).alias("share"))
    parts = [below]
    for d in range(hops - 1, 0, -1):
        from_below = below.select("s", F.col("v").alias("w"), (((1.0 + F.col("share")) / F.col("paths"))).alias("give"))
        given = from_below.join(links, from_below.w == links.src).select("s", F.col("dst").alias("v"), "give").groupBy("s", "v").agg(F.sum("give").alias("give"))
        here = pairs.where(F.col("dist") == d).select("s", "v", "paths")
        below = cut(here.join(given, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("give", F.lit(0.0))).alias("share")), "share")
        parts.append(below)
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("bc"))
