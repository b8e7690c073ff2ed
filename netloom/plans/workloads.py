"""Named graph workloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from netloom.operators import components, isomorphism, neighbourhood, paths, rank
from netloom.plans.graph import PropertyGraph

#: name -> (graph, options) -> result
WORKLOADS: dict[str, Callable[[PropertyGraph, dict], DataFrame]] = {
    "count-vertices": lambda g, o: neighbourhood.count_vertices(g),
    "count-edges": lambda g, o: neighbourhood.count_edges(g),
    "degree": lambda g, o: neighbourhood.degree(g),
    "in-degree": lambda g, o: neighbourhood.in_degree(g),
    "out-degree": lambda g, o: neighbourhood.out_degree(g),
    "neighbors": lambda g, o: neighbourhood.neighbors(g),
    "in-neighbors": lambda g, o: neighbourhood.in_neighbors(g),
    "out-neighbors": lambda g, o: neighbourhood.out_neighbors(g),
    "in-edges": lambda g, o: neighbourhood.in_edges(g),
    "out-edges": lambda g, o: neighbourhood.out_edges(g),
    "edges-with-properties": lambda g, o: neighbourhood.edges_with_properties(g, o.get("where", "true")),
    "pagerank": lambda g, o: rank.pagerank(g, o.get("tol", 0.001), o.get("iterations")),
    "connected-components": lambda g, o: components.connected_components(g),
    "strongly-connected-components": lambda g, o: components.strongly_connected_components(g, o.get("iterations")),
    "triangle-count": lambda g, o: components.triangle_count(g),
    "bfs": lambda g, o: paths.bfs(g, o["source"], o["target"]),
    "sssp": lambda g, o: paths.sssp(g, o["source"]),
    "closeness": lambda g, o: paths.closeness(g, o["source"]),
    "betweenness": lambda g, o: paths.betweenness(g, o.get("iterations", 2)),
    "subgraph-isomorphism": lambda g, o: isomorphism.subgraph_isomorphism(g, o["pattern"]),
}
