"""Counts, degrees, neighbours and edges of vertices.

Lists are per vertex by definition of these results; degrees and counts never build
one. Edges with null ends are ignored where an end is grouped on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.plans.graph import PropertyGraph


def count_vertices(g: PropertyGraph) -> DataFrame:
    return g.vertices.agg(F.count("*").alias("vertices"))


def count_edges(g: PropertyGraph) -> DataFrame:
    return g.edges.agg(F.count("*").alias("edges"))


def degree(g: PropertyGraph) -> DataFrame:
    """(id, degree) over in- and out-edges; a loop counts twice; zero is left out."""
    return g.edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def in_degree(g: PropertyGraph) -> DataFrame:
    return g.edges.select(F.col("dst").alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def out_degree(g: PropertyGraph) -> DataFrame:
    return g.edges.select(F.col("src").alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def _collected(g: PropertyGraph, pairs: DataFrame, only_linked: bool) -> DataFrame:
    lists = pairs.groupBy("id").agg(F.sort_array(F.collect_list("n")).alias("neighbors"))
    if only_linked:
        return lists
    return g.vertices.join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def neighbors(g: PropertyGraph, only_linked: bool = False) -> DataFrame:
    """(id, neighbors): with multiplicity, a loop twice; vertices without any get an empty list, or are left out."""
    pairs = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("id"), F.col("src").alias("n")))).alias("p")).select("p.*")
    return _collected(g, pairs, only_linked)


def in_neighbors(g: PropertyGraph, only_linked: bool = False) -> DataFrame:
    return _collected(g, g.edges.select(F.col("dst").alias("id"), F.col("src").alias("n")), only_linked)


def out_neighbors(g: PropertyGraph, only_linked: bool = False) -> DataFrame:
    return _collected(g, g.edges.select(F.col("src").alias("id"), F.col("dst").alias("n")), only_linked)


def in_edges(g: PropertyGraph) -> DataFrame:
    """(id, edges): structs of all columns, sorted; only vertices that have some."""
    return g.edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*g.edges.columns))).alias("edges"))


def out_edges(g: PropertyGraph) -> DataFrame:
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*g.edges.columns))).alias("edges"))


def edges_with_properties(g: PropertyGraph, condition: Column | str) -> DataFrame:
    """Edges that meet a condition on their properties."""
    return g.edges.where(condition)
