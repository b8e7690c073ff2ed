"""How far a synthetic graph is from its seed: distances of degree and rank distributions.

Values are put in buckets by whole numbers, so that no key is a rounded float.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import neighbourhood, rank
from netloom.plans.graph import PropertyGraph
from netloom.plans.iterate import cut


def smallest_gap(values: DataFrame, column: str) -> float | None:
    """The smallest difference of distinct values; None for fewer than two.

    Distinct values are ordered range by range; gaps between ranges come from each
    range's ends, a row per partition.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = cut(values.select(F.col(column).cast("double").alias("x")).distinct().repartitionByRange(n, "x").withColumn("part", F.spark_partition_id()), "values")
    inner = v.withColumn("gap", F.col("x") - F.lag("x").over(Window.partitionBy("part").orderBy("x"))).agg(F.min("gap")).first()[0]
    ends = v.groupBy("part").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    outer = ends.withColumn("gap", F.col("lo") - F.lag("hi").over(Window.orderBy("part"))).agg(F.min("gap")).first()[0]
    gaps = [x for x in (inner, outer) if x is not None]
    return min(gaps) if gaps else None


def normalized(values: DataFrame, column: str, bucket: float) -> DataFrame:
    """(bucket, key, p): the share of each bucket of k / sum(k), buckets bucket / sum(k) wide; key is its float value."""
    k = values.select(F.col(column).cast("double").alias("k"))
    sums = k.agg(F.sum("k").alias("total"), F.count("*").alias("n"))
    cell = F.floor(F.col("k") / bucket + 1e-9).cast("long") if bucket > 0 else F.col("k")
    counts = k.groupBy(cell.alias("bucket")).agg(F.count("*").alias("c"))
    width = bucket if bucket > 0 else 1.0
    return counts.crossJoin(F.broadcast(sums)).select("bucket", (F.col("bucket") * width / F.col("total")).alias("key"), (F.col("c") / F.col("n")).alias("p"), "total")  # one row


def euclidean(a: DataFrame, b: DataFrame, on: str = "bucket", mode: str = "strict") -> DataFrame:
    """(distance) of two distributions (on, p). ``compat`` leaves the share of a key of one side unsquared."""
    both = a.select(on, "p").unionByName(b.select(on, "p")).groupBy(on).agg(F.count("*").alias("n"), F.max("p").alias("hi"), F.min("p").alias("lo"))
    alone = F.col("hi") if mode == "compat" else F.pow("hi", F.lit(2.0))
    term = F.when(F.col("n") == 2, F.pow(F.col("hi") - F.col("lo"), F.lit(2.0))).otherwise(alone)
    return both.agg(F.sqrt(F.coalesce(F.sum(term), F.lit(0.0))).alias("distance"))


def veracity(seed: DataFrame, synth: DataFrame, column: str, mode: str = "strict") -> DataFrame:
    """(veracity): distance of the two bucketed distributions, times bucket / sum of the synthetic side."""
    gaps = [x for x in (smallest_gap(seed, column), smallest_gap(synth, column)) if x is not None]
    if not gaps:
        raise ValueError("neither graph has two distinct values")
    bucket = min(gaps)
    total = synth.agg(F.sum(F.col(column).cast("double"))).first()[0]
    # keys are shares of each side's own sum: as whole numbers of buckets they are k * bucket / total
    a, b = normalized(seed, column, bucket), normalized(synth, column, bucket)
    on = "key" if mode == "compat" else "bucket"
    return euclidean(a, b, on, mode).select((F.col("distance") * F.lit(bucket / total)).alias("veracity"))


def histograms(seed: DataFrame, synth: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(key, p) of both sides: what :func:`veracity` compares."""
    gaps = [x for x in (smallest_gap(seed, column), smallest_gap(synth, column)) if x is not None]
    if not gaps:
        raise ValueError("neither graph has two distinct values")
    return tuple(normalized(df, column, min(gaps)).select("key", "p") for df in (seed, synth))


def degree_veracity(seed: PropertyGraph, synth: PropertyGraph, mode: str = "strict") -> DataFrame:
    return veracity(neighbourhood.degree(seed), neighbourhood.degree(synth), "degree", mode)


def in_degree_veracity(seed: PropertyGraph, synth: PropertyGraph, mode: str = "strict") -> DataFrame:
    return veracity(neighbourhood.in_degree(seed), neighbourhood.in_degree(synth), "degree", mode)


def out_degree_veracity(seed: PropertyGraph, synth: PropertyGraph, mode: str = "strict") -> DataFrame:
    return veracity(neighbourhood.out_degree(seed), neighbourhood.out_degree(synth), "degree", mode)


def pagerank_veracity(seed: PropertyGraph, synth: PropertyGraph, mode: str = "strict", tol: float = 0.001) -> DataFrame:
    return veracity(rank.pagerank(seed, tol), rank.pagerank(synth, tol), "rank", mode)


METRICS = {"degree": degree_veracity, "in-degree": in_degree_veracity, "out-degree": out_degree_veracity, "pagerank": pagerank_veracity}

#: metric -> (values of a graph, their column)
VALUES = {
    "degree": (neighbourhood.degree, "degree"), "in-degree": (neighbourhood.in_degree, "degree"), "out-degree": (neighbourhood.out_degree, "degree"), "pagerank": (lambda g: rank.pagerank(g, 0.001), "rank"),
}
