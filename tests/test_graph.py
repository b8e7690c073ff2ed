"""The toy graph: V = {1, 2, 3, 4, 5, 9}, E = {1-2 twice, 2-3, 3-1, 3-4, 4-4, 4-5}."""

import os

import pytest

from netloom.operators import components as C
from netloom.operators import isomorphism as I
from netloom.operators import neighbourhood as N
from netloom.operators import paths as P
from netloom.operators import rank as R
from netloom.operators import veracity as V
from netloom.plans.graph import PropertyGraph
from netloom.plans.workloads import WORKLOADS

EDGES = [(1, 2), (1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (4, 5)]


@pytest.fixture(scope="module")
def toy(spark):
    return PropertyGraph(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "id long"), spark.createDataFrame(EDGES, "src long, dst long"))


@pytest.fixture(scope="module")
def empty(spark):
    return PropertyGraph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long"))


def rows(df):
    return {r[0]: r[1] for r in df.collect()}


def test_counts_and_degrees(toy):
    assert N.count_vertices(toy).first()[0] == 6 and N.count_edges(toy).first()[0] == 7
    assert rows(N.degree(toy)) == {1: 3, 2: 3, 3: 3, 4: 4, 5: 1}
    assert rows(N.in_degree(toy)) == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1}
    assert rows(N.out_degree(toy)) == {1: 2, 2: 1, 3: 2, 4: 2}


def test_neighbours(toy):
    assert rows(N.neighbors(toy)) == {1: [2, 2, 3], 2: [1, 1, 3], 3: [1, 2, 4], 4: [3, 4, 4, 5], 5: [4], 9: []}
    assert rows(N.in_neighbors(toy)) == {1: [3], 2: [1, 1], 3: [2], 4: [3, 4], 5: [4], 9: []}
    assert rows(N.out_neighbors(toy)) == {1: [2, 2], 2: [3], 3: [1, 4], 4: [4, 5], 5: [], 9: []}
    assert set(rows(N.in_neighbors(toy, only_linked=True))) == {1, 2, 3, 4, 5}
    assert {k: len(v) for k, v in rows(N.in_edges(toy)).items()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1}


def test_components(toy):
    assert rows(C.connected_components(toy)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}
    assert rows(C.strongly_connected_components(toy)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 9: 9}
    assert rows(C.triangle_count(toy)) == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 9: 0}
    assert rows(C.directed_triangles(toy)) == {1: 2, 2: 2, 3: 2}
    with pytest.raises(ValueError):
        C.strongly_connected_components(toy, 0)


def test_pagerank(toy):
    got = rows(R.pagerank(toy, normalize=True))
    want = {1: 0.8657, 2: 1.0706, 3: 1.2467, 4: 1.5046, 5: 0.9757, 9: 0.3367}
    assert all(abs(got[k] - want[k]) < 0.01 for k in want) and abs(sum(got.values()) - 6) < 1e-6


def test_paths(toy):
    assert {r["id"]: r["dist"] for r in P.sssp(toy, 1).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert [r["id"] for r in P.bfs(toy, 1, 5).orderBy("step").collect()] == [1, 2, 3, 4, 5]
    assert P.bfs(toy, 1, 1).count() == 0 and P.bfs(toy, 5, 1).count() == 0 and P.bfs(toy, 1, 77).count() == 0
    want = {1: 0.6, 2: 0.75, 3: 1.0, 4: 6.0, 5: -1.0, 9: -1.0}
    assert {v: round(P.closeness(toy, v).first()[0], 6) for v in want} == want


def test_betweenness(toy):
    assert set(rows(P.betweenness(toy, 1)).values()) == {0.0}
    assert rows(P.betweenness(toy, 2)) == {1: 0.0, 2: 0.0, 3: 4.0, 4: 2.0, 5: 0.0, 9: 0.0}
    assert rows(P.betweenness(toy, 3)) == {1: 0.0, 2: 0.0, 3: 8.0, 4: 6.0, 5: 0.0, 9: 0.0}
    with pytest.raises(ValueError):
        P.betweenness(toy, 0)


def test_isomorphism(toy):
    assert I.embeddings(toy, [(1, 2), (2, 3), (3, 1)]).count() == 3
    assert I.embeddings(toy, [(1, 2), (2, 3)]).count() == 5
    assert I.embeddings(toy, [(1, 2), (1, 3)]).count() == 2
    long = I.subgraph_isomorphism(toy, [(1, 2), (2, 3), (3, 1)])
    assert long.count() == 9 and long.select("subgraph").distinct().count() == 3


def test_veracity_of_a_graph_with_itself(toy):
    for name in ("degree", "in-degree", "out-degree"):
        assert V.METRICS[name](toy, toy).first()[0] == 0.0
    assert V.degree_veracity(toy, toy, mode="compat").first()[0] == 0.0


def test_relabelling(toy):
    g = toy.relabelled()
    assert sorted(r[0] for r in g.vertices.collect()) == list(range(6))
    assert sorted(map(tuple, g.edges.collect())) == sorted((a - 1, b - 1) for a, b in EDGES)


def test_workloads_of_an_empty_graph(empty):
    for name, run in WORKLOADS.items():
        if name in ("edges-with-properties", "in-edges", "out-edges"):
            continue
        out = run(empty, {"source": 1, "target": 2, "pattern": [(1, 2)], "iterations": 1}).collect()
        assert not out or name in ("count-vertices", "count-edges", "closeness"), name


def scattered(spark):
    """Components of many sizes: a path, a star, a ring with chords, triangles; ids far apart and out of order."""
    links = [(k, k + 1) for k in range(150)] + [(1000, 1001 + k) for k in range(200)] + [(2000 + k, 2000 + (k * step + 1) % 90) for k in range(90) for step in (1, 7)]
    links += [(3000 + 3 * k + i, 3000 + 3 * k + j) for k in range(40) for i, j in ((0, 1), (1, 2), (2, 0), (1, 1))] + [(9000, 9000)]
    links = [((a * 7919) % 10007 - 5000, (b * 7919) % 10007 - 5000) for a, b in links]
    near = {v: {b for e in links for a, b in (e, e[::-1]) if a == v != b} for e in links for v in e}
    want = {}
    for v in near:
        dist, level = {v: 0}, {v}
        while level:
            level = {b for a in level for b in near[a]} - dist.keys()
            dist |= dict.fromkeys(level, max(dist.values()) + 1)
        if len(dist) > 1:
            want[v] = sum(1 / d for d in dist.values() if d)
    return PropertyGraph.of_edges(spark.createDataFrame(links, "src long, dst long")), want


def close(got, want):
    return got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


@pytest.mark.parametrize("state, pack, piece", [(64_000_000, 4096, 2_000_000), (1, 1, 1), (20_000, 50, 37)])
def test_harmonic_closeness_of_all_reached(spark, monkeypatch, state, pack, piece):
    for name, value in (("STATE", state), ("PACK", pack), ("PIECE", piece)):
        monkeypatch.setattr(P.reach, name, value)
    g, want = scattered(spark)
    ids, indptr, cols, starts = P.reach._ordered(*(g.undirected().where("src < dst").toArrow()[c].to_numpy() for c in ("src", "dst")))
    got = {int(v): x for block in P.reach._blocks(starts, len(ids)) for v, x in zip(ids[block[2] : block[3]], P.reach._sums(indptr, cols, *block), strict=True)}
    assert len(starts) == 43 and close(got, want)
    assert close(rows(P.harmonic_closeness(g, None)), want)


def test_harmonic_closeness_writes_no_pairs(spark, monkeypatch):
    written, cut = [], P.cut

    def counting(df, name):
        written.append((df := cut(df, name)).count())
        return df

    monkeypatch.setattr(P, "cut", counting)
    star = PropertyGraph.of_edges(spark.createDataFrame([(0, k) for k in range(1, 201)], "src long, dst long"))
    assert close(rows(P.harmonic_closeness(star, None)), {0: 200.0} | dict.fromkeys(range(1, 201), 1 + 199 / 2))
    assert sum(written) <= 2 * 400


def test_harmonic_closeness_where_paths_outgrow_a_long(spark):
    diamonds = [e for k in range(0, 210, 3) for e in ((k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3))]
    got = rows(P.harmonic_closeness(PropertyGraph.of_edges(spark.createDataFrame(diamonds, "src long, dst long")), None))
    assert len(got) == 211 and abs(got[0] - sum((2 if d % 2 else 1) / d for d in range(1, 141))) < 1e-9


def test_harmonic_closeness_past_memory(spark, toy, empty, monkeypatch):
    near = rows(P.harmonic_closeness(toy, None))
    assert close(near, {1: 2 + 1 / 2 + 1 / 3, 2: 2 + 1 / 2 + 1 / 3, 3: 3.5, 4: 2 + 2 / 2, 5: 1 + 1 / 2 + 2 / 3})
    assert not rows(P.harmonic_closeness(empty, None))
    monkeypatch.setattr(P, "IN_MEMORY", 0)
    monkeypatch.setattr(P, "PAIRS", 12)
    gone = []
    monkeypatch.setattr(P, "discard", lambda df, do=P.discard: gone.append(set(df.inputFiles())) or do(df))
    assert close(rows(P.harmonic_closeness(toy, None)), near)
    assert len(gone) == 3 and not any(os.path.exists(f.removeprefix("file://")) for files in gone for f in files)
    assert close(rows(P.harmonic_closeness(toy, 2)), {1: 2.5, 2: 2.5, 3: 3.5, 4: 3.0, 5: 1.5})
