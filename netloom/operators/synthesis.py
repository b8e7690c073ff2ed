"""Synthetic graphs: preferential attachment and stochastic Kronecker graphs.

Random numbers are hashes of (seed, stream, entity), so a lost task that runs again
draws the same graph.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.scalar import random_long, random_unit
from netloom.operators.distributions import data_distributions, generate_properties, sample
from netloom.plans.graph import PropertyGraph
from netloom.plans.iterate import cut


def with_edge_ids(links: DataFrame) -> DataFrame:
    """(src, dst, edge): parallel edges are numbered, and edge is (src, dst, number) as text."""
    merged = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return merged.select("src", "dst", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).withColumn("edge", F.concat_ws(":", "src", "dst", "k")).drop("k")


def poisson_bounds(mean: float) -> list[float]:
    """P(N < 1), P(N < 2), ... of a Poisson N, up to the last that a uniform number of 52 bits can reach."""
    p, k, out = math.exp(-mean), 0, []
    acc = p
    while acc < 1 - 2.0**-52 and (k < mean or p > 1e-18):
        out.append(acc)
        k += 1
        p *= mean / k
        acc += p
    return out


def barabasi_albert(seed_graph: PropertyGraph, dists: DataFrame, iterations: int, fraction: float = 0.1, seed: int = 42, compat_edges: bool = True) -> DataFrame:
    """(src, dst) of a larger graph by parallel preferential attachment.

    Each round samples edges with replacement; each sampled edge gives a new vertex that
    is tied to its source or target with drawn numbers of out- and in-edges, one less of
    each with ``compat_edges``. New ids follow the largest so far.
    """
    if iterations < 1:
        raise ValueError("iterations must be positive")
    if not 0 <= fraction <= 100:
        raise ValueError("fraction must be between 0 and 100")
    edges = cut(seed_graph.relabelled().links, "ba")
    for r in range(iterations):
        top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        rows = with_edge_ids(edges)
        rows = rows.withColumn("u", random_unit(seed, f"take{r}", F.col("edge")))
        copies = F.aggregate(F.array(*[F.lit(x) for x in poisson_bounds(fraction)]), F.lit(0), lambda n, x: n + (F.col("u") >= x).cast("int"))
        taken = rows.withColumn("copies", copies).drop("u").where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        taken = taken.withColumn("draw", F.concat_ws("#", "edge", "copy"))
        old = F.when(random_long(seed, f"side{r}", F.col("draw")) % 2 == 0, F.col("src")).otherwise(F.col("dst"))
        drawn = sample(sample(taken.select(old.alias("old"), "draw"), "draw", dists, "outDegree", seed + r, into="outs"), "draw", dists, "inDegree", seed + r, into="ins")
        from netloom.plans.graph import dense_ids

        drawn = cut(drawn, "drawn")
        ids = dense_ids(drawn.select(F.col("draw").alias("id"))).select(F.col("id").alias("draw"), (F.col("rank") + top + 1).alias("new"))
        less = 1 if compat_edges else 0
        made = drawn.join(ids, "draw").select("old", "new", (F.col("outs").cast("int") - less).alias("o"), (F.col("ins").cast("int") - less).alias("i"))
        outs = made.where("o > 0").select(F.col("new").alias("src"), F.col("old").alias("dst"), F.explode(F.sequence(F.lit(1), "o")).alias("k"))
        ins = made.where("i > 0").select(F.col("old").alias("src"), F.col("new").alias("dst"), F.explode(F.sequence(F.lit(1), "i")).alias("k"))
        edges = cut(edges.unionByName(outs.drop("k")).unionByName(ins.drop("k")), "ba")
    return edges


def kronecker_cells(matrix: list[list[float]]) -> list[tuple[int, int, float]]:
    return [(i, j, p) for i, row in enumerate(matrix) for j, p in enumerate(row) if p > 0]


def kronecker_attempts(spark, matrix: list[list[float]], k: int, first: int, n: int, seed: int) -> DataFrame:
    """(attempt, src, dst): attempts first .. first + n - 1, k cell draws each, most significant digit first."""
    cells, size = kronecker_cells(matrix), len(matrix)
    total = sum(p for _, _, p in cells)
    bounds, acc = [], 0.0
    for _, _, p in cells[:-1]:
        acc += p / total
        bounds.append(int(acc * (1 << 52)))
    rows = spark.range(first, first + n).withColumnRenamed("id", "attempt")
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for digit in range(k):
        u = f"u{digit}"
        rows = rows.withColumn(u, random_long(seed, "kro", F.col("attempt"), digit))
        i, j = F.lit(cells[-1][0]), F.lit(cells[-1][1])
        for (a, b, _), bound in reversed(list(zip(cells[:-1], bounds, strict=True))):
            i, j = F.when(F.col(u) < bound, a).otherwise(i), F.when(F.col(u) < bound, b).otherwise(j)
        src, dst = src * size + i, dst * size + j
    return rows.select("attempt", src.alias("src"), dst.alias("dst"))


def kronecker_links(spark, matrix: list[list[float]], iterations: int, seed: int = 42) -> DataFrame:
    """(src, dst): the first floor(S^k) distinct edges of an endless sequence of attempts."""
    cells = kronecker_cells(matrix)
    wanted = math.floor(sum(p for _, _, p in cells) ** iterations)
    if iterations < 1 or len(cells) ** iterations < wanted:
        raise ValueError("the matrix has too few cells above zero for that many edges")
    n, tried, firsts = 0, max(16, 2 * wanted), None
    while firsts is None or firsts.count() < wanted:  # only attempts that are new are made
        fresh = kronecker_attempts(spark, matrix, iterations, n, tried, seed)
        both = fresh if firsts is None else firsts.select("attempt", "src", "dst").unionByName(fresh)
        n, tried = n + tried, n + tried
        firsts = cut(both.groupBy("src", "dst").agg(F.min("attempt").alias("attempt")), "attempts")
    return firsts.where(F.col("attempt") <= smallest(firsts, "attempt", wanted, n)).select("src", "dst")


def smallest(rows: DataFrame, column: str, k: int, below: int, bins: int = 4096) -> int:
    """The k-th smallest of a column's distinct numbers from 0 to ``below`` - 1, by histograms of ``bins`` bins."""
    lo, width = 0, below
    while width > 1:
        step = -(-width // bins)
        inside = rows.where((F.col(column) >= lo) & (F.col(column) < lo + width))
        for r in inside.groupBy(F.floor((F.col(column) - lo) / step).cast("long").alias("bin")).count().orderBy("bin").collect():  # at most ``bins`` rows
            if k <= r["count"]:
                lo, width = lo + r["bin"] * step, step
                break
            k -= r["count"]
    return lo


def kronecker(spark, matrix: list[list[float]], iterations: int, dists: DataFrame, seed: int = 42) -> DataFrame:
    """(src, dst): Kronecker links, each as often as a drawn multiplicity says."""
    links = kronecker_links(spark, matrix, iterations, seed).withColumn("edge", F.concat_ws(":", "src", "dst"))
    many = sample(links, "edge", dists, "outDegree", seed, into="m")
    return many.select("src", "dst", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("m").cast("int")))).alias("k")).drop("k")


def synthesize(seed_graph: PropertyGraph, method: str, properties: bool = True, seed: int = 42, dists: DataFrame | None = None, **options) -> PropertyGraph:
    """A synthetic graph by ``ba`` or ``kro``, with drawn edge properties unless excluded."""
    dists = cut(dists if dists is not None else data_distributions(seed_graph), "dists")
    if method == "ba":
        links = barabasi_albert(seed_graph, dists, seed=seed, **options)
    elif method == "kro":
        links = kronecker(seed_graph.edges.sparkSession, dists=dists, seed=seed, **options)
    else:
        raise ValueError(f"unknown method {method}")
    edges = generate_properties(with_edge_ids(links), dists, seed) if properties else links
    return PropertyGraph.of_edges(cut(edges, "synth"))
