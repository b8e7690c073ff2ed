"""Subgraph isomorphism: injective, directed, non-induced embeddings, as joins.

Candidates are pruned by distinct in- and out-degrees; the pattern's edges are then
joined in an order that stays connected and starts at the vertex with most edges.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.graph import PropertyGraph
from netloom.plans.iterate import cut


def join_order(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pattern edges so that each but the first of a component touches one before it."""
    left, seen, order = sorted(set(edges)), set(), []
    weight = Counter(x for e in left for x in e)
    while left:
        touching = [e for e in left if e[0] in seen or e[1] in seen] or left
        best = max(touching, key=lambda e: ((e[0] in seen) + (e[1] in seen), weight[e[0]] + weight[e[1]], [-e[0], -e[1]]))
        order.append(best)
        seen |= set(best)
        left.remove(best)
    return order


def embeddings(g: PropertyGraph, pattern: list[tuple[int, int]]) -> DataFrame:
    """One row per embedding, a column ``p<vertex>`` for each pattern vertex.

    ``pattern`` is a list of directed edges (bounded, held on the driver); loops in it
    ask for loops of the graph. Parallel edges count once.
    """
    if not pattern:
        raise ValueError("the pattern has no edges")
    links = cut(g.links.distinct(), "links")
    plain = [e for e in set(pattern) if e[0] != e[1]]
    outs, ins = Counter(a for a, _ in plain), Counter(b for _, b in plain)
    simple = links.where("src <> dst")
    degrees = simple.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")).join(simple.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i")), "id", "full")
    degrees = cut(degrees.select("id", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i")), "degrees")
    rows: DataFrame | None = None
    bound: list[int] = []
    for a, b in join_order(pattern):
        e = links.where("src = dst") if a == b else simple
        for vertex, column in {a: "src", b: "dst"}.items():
            fit = degrees.where((F.col("o") >= outs[vertex]) & (F.col("i") >= ins[vertex])).select(F.col("id").alias(column))
            if a != b and (outs[vertex] > 1 or ins[vertex] > 1 or (outs[vertex] and ins[vertex])):
                e = e.join(fit, column, "left_semi")
        e = e.select(F.col("src").alias(f"p{a}")) if a == b else e.select(F.col("src").alias(f"p{a}"), F.col("dst").alias(f"p{b}"))
        if rows is None:
            rows = e
        else:
            shared = [f"p{x}" for x in dict.fromkeys((a, b)) if x in bound]
            rows = rows.join(e, shared) if shared else rows.crossJoin(e)  # only for a pattern in several parts
        for x in dict.fromkeys((a, b)):
            if x not in bound:
                for y in bound:
                    rows = rows.where(F.col(f"p{x}") != F.col(f"p{y}"))
                bound.append(x)
    return rows.select(*[f"p{x}" for x in sorted(bound)])


def subgraph_isomorphism(g: PropertyGraph, pattern: list[tuple[int, int]]) -> DataFrame:
    """(subgraph, pattern_id, target_id): a row per pattern vertex of each embedding; subgraph is a hash of it."""
    rows = embeddings(g, pattern)
    cells = F.array(*[F.struct(F.lit(int(c[1:])).cast("long").alias("pattern_id"), F.col(c).alias("target_id")) for c in rows.columns])
    return rows.select(F.md5(F.concat_ws(",", *rows.columns)).alias("subgraph"), F.explode(cells).alias("x")).select("subgraph", "x.*")
