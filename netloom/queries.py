"""The registered graph queries over the driver's tables, and the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import components, distributions, isomorphism, neighbourhood, paths, rank, synthesis, veracity
from netloom.plans.graph import EDGE_FIELDS, PROPERTIES, PropertyGraph, dense_ids, flows, hops
from netloom.plans.iterate import cut, place
from netloom.sources import graphs
from netloom.sources.connlog import parse_lines
from netloom.sources.graphs import edges_as_text

MATRIX = [[0.9, 0.7], [0.5, 0.2]]
SEED = 42


def _flows(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.of_edges(flows(spark, sf_dir))


def _hops(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.of_edges(cut(hops(spark, sf_dir), "hops"))


def _first(g: PropertyGraph, column: str = "src") -> int:
    return g.edges.agg(F.min(column)).first()[0]


def _path(spark: SparkSession, sf_dir: str, directed: bool) -> DataFrame:
    g = _hops(spark, sf_dir)
    return paths.bfs(g, _first(g), g.edges.agg(F.max("dst")).first()[0], directed)


def _stored(spark: SparkSession, sf_dir: str, save: Callable, load: Callable) -> DataFrame:
    """The flows, saved and loaded again."""
    at = place(spark, "stored")
    save(_flows(spark, sf_dir), at)
    return load(spark, at).edges


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the four bulk-import files of the flows, by file."""
    at = place(spark, "import")
    graphs.save_import_csv(_flows(spark, sf_dir), at)
    files = ["nodes_header", "relationships_header", "nodes", "relationships"]
    return reduce(DataFrame.unionByName, [spark.read.text(f"{at}_{f}").select(F.lit(f).alias("file"), F.col("value").alias("line")) for f in files])


def degree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the degrees as key,value files."""
    at = place(spark, "pairs")
    graphs.save_pairs(neighbourhood.degree(_flows(spark, sf_dir)), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import's relationships, merged to one file and read again."""
    at = place(spark, "merge")
    graphs.save_import_csv(_flows(spark, sf_dir), at)
    graphs.merge_parts(spark, f"{at}_relationships", f"{at}.csv")
    return spark.read.text(f"{at}.csv").select(F.col("value").alias("line"))


def stored_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = place(spark, "distributions")
    graphs.save_distributions(distributions.data_distributions(_flows(spark, sf_dir)), at)
    return graphs.load_distributions(spark, at)


def generated_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve properties drawn for every edge of the flows."""
    g = _flows(spark, sf_dir)
    dists = cut(distributions.data_distributions(g), "dists")
    return distributions.generate_properties(synthesis.with_edge_ids(g.links), dists, SEED)


def _joined(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ","))


def _edge_lists(df: DataFrame) -> DataFrame:
    return df.withColumn("edges", F.array_join(F.transform("edges", lambda e: F.concat_ws(":", e["src"], e["dst"], e["ts"], e["origBytes"])), ","))


def _slim(g: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(g.vertices, g.edges.select("src", "dst", "ts", "origBytes"))


def _half(g: PropertyGraph, state: str) -> PropertyGraph:
    return PropertyGraph.of_edges(g.edges.where(F.col("connState") == state))


def _rounded(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as connection-log lines, with comments, IPv6, icmp and missing numbers among them."""
    e = flows(spark, sf_dir)
    address = lambda c: F.concat_ws(".", F.lit("10"), ((F.col(c) / 65536).cast("long") % 256), ((F.col(c) / 256).cast("long") % 256), F.col(c) % 256)
    dash = F.lit("-")
    cells = [
        F.concat(F.col("ts").cast("string"), F.lit(".25")), F.lit("u"), F.when(F.col("origBytes") % 11 == 0, F.lit("fe80::1")).otherwise(address("src")), F.col("origPort").cast("string"), address("dst"), F.col("respPort").cast("string"),
        F.when(F.col("origBytes") % 7 == 0, "icmp").otherwise(F.lower("proto")), dash, F.when(F.col("respPkts") % 5 == 0, dash).otherwise(F.lit("0.5")), F.col("origBytes").cast("string"), F.when(F.col("respPkts") % 3 == 0, dash).otherwise(F.col("respBytes").cast("string")),
        F.when(F.col("connState") == "S0", "weird").otherwise(F.lower("connState")), dash, dash, F.lit("0"), F.lit("Dd"), F.col("origPkts").cast("string"), F.col("origIpBytes").cast("string"), F.col("respPkts").cast("string"), F.col("respIpBytes").cast("string"), F.lit("(empty)"),
    ]
    lines = e.select(F.concat_ws("\t", *cells).alias("value"))
    return lines.unionByName(spark.createDataFrame([("#fields\tts\tuid",), ("",)], "value string"))


def sampled_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _flows(spark, sf_dir)
    dists = cut(distributions.data_distributions(g), "dists")
    rows = synthesis.with_edge_ids(g.links)
    rows = distributions.sample(rows, "edge", dists, "origBytes", SEED)
    return distributions.sample(rows, "edge", dists, "respBytes", SEED, cond="origBytes").select("edge", "origBytes", "respBytes")


def ba_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _hops(spark, sf_dir)
    dists = cut(distributions.data_distributions(PropertyGraph(g.vertices, flows(spark, sf_dir))), "dists")
    return synthesis.barabasi_albert(g, dists, iterations=2, fraction=0.2, seed=SEED).groupBy("src", "dst").agg(F.count("*").alias("n"))


def kro_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _flows(spark, sf_dir)
    dists = cut(distributions.data_distributions(g), "dists")
    return synthesis.synthesize(g, "kro", seed=SEED, dists=dists, matrix=MATRIX, iterations=8).edges


def kronecker_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.operators.kronfit import fit_kronecker

    return fit_kronecker(_hops(spark, sf_dir), seed=SEED)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "flows_view": lambda s, d: flows(s, d),
    "hops_view": lambda s, d: hops(s, d),
    "count_vertices": lambda s, d: neighbourhood.count_vertices(_flows(s, d)),
    "count_edges": lambda s, d: neighbourhood.count_edges(_flows(s, d)),
    "degree": lambda s, d: neighbourhood.degree(_flows(s, d)),
    "in_degree": lambda s, d: neighbourhood.in_degree(_flows(s, d)),
    "out_degree": lambda s, d: neighbourhood.out_degree(_flows(s, d)),
    "neighbors": lambda s, d: _joined(neighbourhood.neighbors(_flows(s, d)), "neighbors"),
    "in_neighbors": lambda s, d: _joined(neighbourhood.in_neighbors(_flows(s, d)), "neighbors"),
    "out_neighbors": lambda s, d: _joined(neighbourhood.out_neighbors(_flows(s, d)), "neighbors"),
    "linked_in_neighbors": lambda s, d: _joined(neighbourhood.in_neighbors(_flows(s, d), only_linked=True), "neighbors"),
    "linked_out_neighbors": lambda s, d: _joined(neighbourhood.out_neighbors(_flows(s, d), only_linked=True), "neighbors"),
    "in_edges": lambda s, d: _edge_lists(neighbourhood.in_edges(_slim(_flows(s, d)))),
    "out_edges": lambda s, d: _edge_lists(neighbourhood.out_edges(_slim(_flows(s, d)))),
    "edges_with_properties": lambda s, d: neighbourhood.edges_with_properties(_flows(s, d), "proto = 'TCP' and origBytes > 40 and connState = 'SF'"),
    "merged_edges": lambda s, d: _flows(s, d).merged(),
    "relabel": lambda s, d: _flows(s, d).relabelled().edges,
    "dense_ids": lambda s, d: dense_ids(_flows(s, d).vertices),
    "multiplicity": lambda s, d: distributions.multiplicity(_flows(s, d)),
    "distributions": lambda s, d: distributions.data_distributions(_flows(s, d)),
    "stored_distributions": stored_distributions,
    "sampled_properties": sampled_properties,
    "generated_properties": generated_properties,
    "pagerank": lambda s, d: _rounded(rank.pagerank(_hops(s, d), tol=None, max_iter=5), "rank"),
    "pagerank_converged": lambda s, d: _rounded(rank.pagerank(_hops(s, d), normalize=True), "rank", 4),
    "pagerank_step": lambda s, d: _rounded(rank.pagerank_step(_hops(s, d)), "rank", 9),
    "connected_components": lambda s, d: components.connected_components(_hops(s, d)),
    "component_representatives": lambda s, d: components.representatives(components.connected_components(_hops(s, d))),
    "strongly_connected_components": lambda s, d: components.strongly_connected_components(_hops(s, d)),
    "strong_representatives": lambda s, d: components.representatives(components.strongly_connected_components(_hops(s, d))),
    "triangle_count": lambda s, d: components.triangle_count(_hops(s, d)),
    "directed_triangles": lambda s, d: components.directed_triangles(_hops(s, d)),
    "bfs": lambda s, d: _path(s, d, True),
    "bfs_undirected": lambda s, d: _path(s, d, False),
    "sssp": lambda s, d: paths.sssp(g := _hops(s, d), _first(g)),
    "sssp_undirected": lambda s, d: paths.sssp(g := _hops(s, d), _first(g), directed=False).select("id", "dist"),
    "closeness": lambda s, d: _rounded(paths.closeness(g := _hops(s, d), _first(g)), "closeness"),
    "harmonic_closeness": lambda s, d: paths.harmonic_closeness(_hops(s, d)),
    "harmonic_closeness_reach": lambda s, d: _rounded(paths.harmonic_closeness(_hops(s, d), None), "closeness"),
    "betweenness": lambda s, d: _rounded(paths.betweenness(_hops(s, d), 2), "bc"),
    "betweenness_3": lambda s, d: _rounded(paths.betweenness(_hops(s, d), 3), "bc"),
    "isomorphism_cycle": lambda s, d: isomorphism.embeddings(_hops(s, d), [(1, 2), (2, 3), (3, 1)]),
    "isomorphism_path": lambda s, d: isomorphism.embeddings(_hops(s, d), [(1, 2), (2, 3)]),
    "isomorphism_rows": lambda s, d: isomorphism.subgraph_isomorphism(_hops(s, d), [(1, 2), (2, 3), (3, 1)]),
    "degree_veracity": lambda s, d: _rounded(veracity.degree_veracity(_half(g := _flows(s, d), "SF"), _half(g, "REJ")), "veracity", 9),
    "in_degree_veracity": lambda s, d: _rounded(veracity.in_degree_veracity(_half(g := _flows(s, d), "SF"), _half(g, "REJ")), "veracity", 9),
    "out_degree_veracity": lambda s, d: _rounded(veracity.out_degree_veracity(_half(g := _flows(s, d), "SF"), _half(g, "REJ")), "veracity", 9),
    "pagerank_veracity": lambda s, d: veracity.pagerank_veracity(_half(g := _flows(s, d), "SF"), _half(g, "REJ")),
    "degree_veracity_compat": lambda s, d: _rounded(veracity.degree_veracity(_half(g := _flows(s, d), "SF"), _half(g, "REJ"), "compat"), "veracity", 9),
    "conn_log": lambda s, d: parse_lines(cut(log_lines(s, d), "lines")),
    "edges_as_text": lambda s, d: edges_as_text(flows(s, d).select("src", "dst")),
    "property_edges_as_text": lambda s, d: edges_as_text(flows(s, d)),
    "stored_graph": lambda s, d: _stored(s, d, graphs.save_graph, graphs.load_graph),
    "stored_text_graph": lambda s, d: _stored(s, d, graphs.save_text, graphs.load_text),
    "import_files": import_files,
    "merged_parts": merged_parts,
    "degree_pairs": degree_pairs,
    "kronecker_links": lambda s, d: synthesis.kronecker_links(s, MATRIX, 8, SEED),
    "kronecker_graph": kro_graph,
    "barabasi_albert": ba_graph,
    "kronecker_fit": kronecker_fit,
}

_FLOWS = """flows AS (
    SELECT o_custkey AS src, CAST(10000000 + l_suppkey AS BIGINT) AS dst, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts,
           CAST(l_partkey % 65536 AS INT) AS "origPort", CAST(l_linenumber AS INT) AS "respPort",
           CASE WHEN l_linestatus = 'F' THEN 'TCP' ELSE 'UDP' END AS proto, l_discount * 100 AS duration,
           CAST(floor(l_quantity) AS BIGINT) AS "origBytes", CAST(floor(l_extendedprice) AS BIGINT) AS "respBytes",
           CASE l_returnflag WHEN 'A' THEN 'SF' WHEN 'N' THEN 'S0' ELSE 'REJ' END AS "connState",
           CAST(l_linenumber AS BIGINT) AS "origPkts", CAST(floor(l_quantity) * 40 AS BIGINT) AS "origIpBytes",
           CAST(l_orderkey % 100 AS BIGINT) AS "respPkts", CAST(floor(l_extendedprice) + 20 * (l_orderkey % 100) AS BIGINT) AS "respIpBytes"
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT src AS id FROM flows UNION SELECT dst FROM flows)"""


def _hops_sql() -> str:
    return """hops AS (
    SELECT DISTINCT src, dst FROM (
        SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_type AS t1,
               lead(event_type) OVER (ORDER BY ts, event_id) AS t2 FROM events)
    WHERE t1 = 'error' AND t2 = 'error'),
hv AS (SELECT src AS id FROM hops UNION SELECT dst FROM hops),
simple AS (SELECT src, dst FROM hops WHERE src <> dst),
both_ways AS (SELECT src, dst FROM simple UNION SELECT dst, src FROM simple)"""


_RANDOM = "CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT)"


def _list(by: str, other: str, all_rows: bool) -> str:
    inner = f"SELECT {by} AS id, string_agg({other}, ',' ORDER BY {other}) AS neighbors FROM flows GROUP BY 1"
    if not all_rows:
        return f"WITH {_FLOWS} {inner}"
    return f"WITH {_FLOWS} SELECT v.id, coalesce(neighbors, '') AS neighbors FROM v LEFT JOIN ({inner}) x ON x.id = v.id"


def _pagerank_sql(rounds: int) -> str:
    steps = [_hops_sql(), "o AS (SELECT src, count(*) AS k FROM hops GROUP BY 1)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS rank FROM hv)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT hv.id, 0.15 + 0.85 * coalesce(sum(r.rank / o.k), 0) AS rank FROM hv LEFT JOIN hops e ON e.dst = hv.id LEFT JOIN r{k} r ON r.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{rounds}"


def _veracity_sql(column: str) -> str:
    pick = {"both": "unnest([src, dst])", "in": "dst", "out": "src"}[column]
    deg = lambda s: f"(SELECT id, count(*) AS k FROM (SELECT {pick} AS id FROM flows WHERE \"connState\" = '{s}') GROUP BY 1)"
    return f"""WITH {_FLOWS}, a AS {deg('SF')}, b AS {deg('REJ')},
        gap AS (SELECT min(g) AS w FROM (SELECT k - lag(k) OVER (ORDER BY k) AS g FROM (SELECT DISTINCT k FROM a) UNION ALL SELECT k - lag(k) OVER (ORDER BY k) FROM (SELECT DISTINCT k FROM b))),
        na AS (SELECT k // (SELECT w FROM gap) AS c, count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY 1),
        nb AS (SELECT k // (SELECT w FROM gap) AS c, count(*) / (SELECT count(*) FROM b) AS p FROM b GROUP BY 1)
        SELECT round(sqrt(sum(pow(coalesce(na.p, 0) - coalesce(nb.p, 0), 2))) * (SELECT w FROM gap) / (SELECT sum(k) FROM b), 9) AS veracity FROM na FULL JOIN nb ON na.c = nb.c"""


_LEVELS = """WITH RECURSIVE {hops}, s0 AS (SELECT min(src) AS s FROM hops),
    reach(id, dist) AS (SELECT s, 0 FROM s0 UNION SELECT e.dst, r.dist + 1 FROM reach r JOIN {links} e ON e.src = r.id WHERE r.dist < 60),
    best AS (SELECT id, min(dist) AS dist FROM reach GROUP BY 1)"""


def _text(column: str) -> str:
    """A property in its bucket, as text."""
    return f'CAST("{column}" - "{column}" % 10 AS VARCHAR)' if column in distributions.BUCKETED else f'CAST("{column}" AS VARCHAR)'


def _generated_sql() -> str:
    """Each property drawn by the number that its edge hashes to, eight of them given the drawn origBytes."""
    draw = lambda name: _RANDOM.format(key=f"'{SEED}|{name}|' || edge")
    steps = [_FLOWS, "e AS (SELECT src, dst, src || ':' || dst || ':' || row_number() OVER (PARTITION BY src, dst) AS edge FROM flows)"]
    for name in distributions.UNCONDITIONAL:
        steps.append(f"d_{name} AS (SELECT x, n, sum(n) OVER (ORDER BY n DESC, x ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER () AS total FROM (SELECT {_text(name)} AS x, count(*) AS n FROM flows GROUP BY 1))")
        steps.append(f"s_{name} AS MATERIALIZED (SELECT edge, x FROM (SELECT edge, {draw(name)} % (SELECT max(total) FROM d_{name}) AS u FROM e) q JOIN d_{name} d ON q.u >= d.hi - d.n AND q.u < d.hi)")
    for name in distributions.CONDITIONAL:
        steps.append(f"d_{name} AS (SELECT o, x, n, sum(n) OVER (PARTITION BY o ORDER BY n DESC, x ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER (PARTITION BY o) AS total FROM (SELECT {_text('origBytes')} AS o, {_text(name)} AS x, count(*) AS n FROM flows GROUP BY 1, 2))")
        steps.append(f"t_{name} AS (SELECT o, max(total) AS total FROM d_{name} GROUP BY 1)")
        steps.append(f"s_{name} AS MATERIALIZED (SELECT edge, d.x FROM (SELECT s.edge, s.x AS o, {draw(name).replace('edge', 's.edge')} % t.total AS u FROM s_origBytes s JOIN t_{name} t ON t.o = s.x) q JOIN d_{name} d ON d.o = q.o AND q.u >= d.hi - d.n AND q.u < d.hi)")
    kinds = {"bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "string": "VARCHAR"}
    columns = ", ".join(f'CAST(s_{n}.x AS {kinds[t.simpleString()]}) AS "{n}"' for n, t in EDGE_FIELDS)
    joins = " ".join(f"JOIN s_{n} ON s_{n}.edge = e.edge" for n, _ in EDGE_FIELDS)
    return f"WITH {', '.join(steps)} SELECT src, dst, {columns} FROM e {joins}"


def _path_sql(links: str) -> str:
    """From the largest target back to the smallest source, by the smallest vertex before."""
    levels = _LEVELS.format(hops=_hops_sql(), links=links)
    return f"""{levels},
        back(step, id) AS (
            SELECT dist, id FROM best WHERE id = (SELECT max(dst) FROM hops) AND id <> (SELECT s FROM s0)
            UNION ALL
            SELECT b.step - 1, (SELECT min(p.id) FROM best p JOIN {links} e ON e.src = p.id WHERE e.dst = b.id AND p.dist = b.step - 1) FROM back b WHERE b.step > 0)
        SELECT step::INT AS step, id FROM back"""


def _compat_sql() -> str:
    """Keys of one side only count by their share, not its square; keys are shares of each side's sum."""
    deg = lambda s: f"(SELECT id, count(*) AS k FROM (SELECT unnest([src, dst]) AS id FROM flows WHERE \"connState\" = '{s}') GROUP BY 1)"
    side = lambda t: f"(SELECT (k // (SELECT w FROM gap)) * (SELECT w FROM gap)::DOUBLE / (SELECT sum(k) FROM {t}) AS c, count(*) / (SELECT count(*) FROM {t}) AS p FROM {t} GROUP BY 1)"
    return f"""WITH {_FLOWS}, a AS {deg('SF')}, b AS {deg('REJ')},
        gap AS (SELECT min(g) AS w FROM (SELECT k - lag(k) OVER (ORDER BY k) AS g FROM (SELECT DISTINCT k FROM a) UNION ALL SELECT k - lag(k) OVER (ORDER BY k) FROM (SELECT DISTINCT k FROM b))),
        na AS {side('a')}, nb AS {side('b')}
        SELECT round(sqrt(sum(CASE WHEN na.p IS NULL THEN nb.p WHEN nb.p IS NULL THEN na.p ELSE pow(na.p - nb.p, 2) END)) * (SELECT w FROM gap) / (SELECT sum(k) FROM b), 9) AS veracity
        FROM na FULL JOIN nb ON na.c = nb.c"""


def _distributions_sql() -> str:
    b = _text
    parts = [f"SELECT '{c}' AS dist, NULL AS cond, {b(c)} AS value FROM flows" for c in distributions.UNCONDITIONAL]
    parts += [f"SELECT '{c}', {b('origBytes')}, {b(c)} FROM flows" for c in distributions.CONDITIONAL]
    pairs = "(SELECT m, count(*) AS n FROM (SELECT count(*) AS m FROM flows GROUP BY src, dst) GROUP BY 1)"
    return f"""WITH {_FLOWS}, raw AS ({' UNION ALL '.join(parts)}), counts AS (SELECT dist, cond, value, count(*) AS n FROM raw GROUP BY ALL
        UNION ALL SELECT d, NULL, CAST(m AS VARCHAR), n FROM {pairs}, (VALUES ('inDegree'), ('outDegree')) t(d))
        SELECT dist, cond, value, n, CAST(sum(n) OVER (PARTITION BY dist, cond) AS BIGINT) AS total,
               CAST(sum(n) OVER w AS BIGINT) AS cum_hi, CAST(sum(n) OVER w - n AS BIGINT) AS cum_lo
        FROM counts WINDOW w AS (PARTITION BY dist, cond ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING)"""


def _kronecker_sql(k: int) -> str:
    cells = synthesis.kronecker_cells(MATRIX)
    total, acc, bounds = sum(p for *_, p in cells), 0.0, []
    for *_, p in cells[:-1]:
        acc += p / total
        bounds.append(int(acc * (1 << 52)))
    wanted = int(total**k)
    pick = lambda which: "CASE " + " ".join(f"WHEN u < {x} THEN {c[which]}" for c, x in zip(cells[:-1], bounds, strict=True)) + f" ELSE {cells[-1][which]} END"
    u = _RANDOM.format(key=f"'{SEED}|kro|' || a || '|' || d")
    return f"""WITH draws AS (SELECT a, d, {u} AS u FROM range(0, {8 * wanted}) t(a), range(0, {k}) x(d)),
        edges AS (SELECT a, CAST(sum(({pick(0)}) * pow(2, {k - 1} - d)) AS BIGINT) AS src, CAST(sum(({pick(1)}) * pow(2, {k - 1} - d)) AS BIGINT) AS dst FROM draws GROUP BY a),
        firsts AS (SELECT src, dst, min(a) AS a FROM edges GROUP BY 1, 2)
        SELECT src, dst FROM firsts ORDER BY a LIMIT {wanted}"""


ORACLE_SQL: dict[str, str] = {
    "flows_view": f"WITH {_FLOWS} SELECT * FROM flows",
    "hops_view": f"WITH {_hops_sql()} SELECT * FROM hops",
    "count_vertices": f"WITH {_FLOWS} SELECT count(*) AS vertices FROM v",
    "count_edges": f"WITH {_FLOWS} SELECT count(*) AS edges FROM flows",
    "degree": f"WITH {_FLOWS} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM flows UNION ALL SELECT dst FROM flows) GROUP BY 1",
    "in_degree": f"WITH {_FLOWS} SELECT dst AS id, count(*) AS degree FROM flows GROUP BY 1",
    "out_degree": f"WITH {_FLOWS} SELECT src AS id, count(*) AS degree FROM flows GROUP BY 1",
    "neighbors": f"WITH {_FLOWS} SELECT id, string_agg(n, ',' ORDER BY n) AS neighbors FROM (SELECT src AS id, dst AS n FROM flows UNION ALL SELECT dst, src FROM flows) GROUP BY 1",
    "in_neighbors": _list("dst", "src", True),
    "out_neighbors": _list("src", "dst", True),
    "linked_in_neighbors": _list("dst", "src", False),
    "linked_out_neighbors": _list("src", "dst", False),
    "in_edges": f"WITH {_FLOWS} SELECT dst AS id, string_agg(concat_ws(':', src, dst, ts, \"origBytes\"), ',' ORDER BY src, dst, ts, \"origBytes\") AS edges FROM flows GROUP BY 1",
    "out_edges": f"WITH {_FLOWS} SELECT src AS id, string_agg(concat_ws(':', src, dst, ts, \"origBytes\"), ',' ORDER BY src, dst, ts, \"origBytes\") AS edges FROM flows GROUP BY 1",
    "edges_with_properties": f"WITH {_FLOWS} SELECT * FROM flows WHERE proto = 'TCP' AND \"origBytes\" > 40 AND \"connState\" = 'SF'",
    "merged_edges": f"WITH {_FLOWS} SELECT src, dst, count(*) AS n FROM flows GROUP BY 1, 2",
    "relabel": f"WITH {_FLOWS}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) SELECT a.k AS src, b.k AS dst FROM flows JOIN r a ON a.id = src JOIN r b ON b.id = dst",
    "dense_ids": f"WITH {_FLOWS} SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM v",
    "multiplicity": f"WITH {_FLOWS} SELECT n, count(*) AS pairs FROM (SELECT count(*) AS n FROM flows GROUP BY src, dst) GROUP BY 1",
    "distributions": _distributions_sql(),
    "stored_distributions": _distributions_sql(),
    "generated_properties": _generated_sql(),
    "sampled_properties": f"""WITH {_FLOWS},
        e AS (SELECT src || ':' || dst || ':' || row_number() OVER (PARTITION BY src, dst) AS edge FROM flows),
        o AS (SELECT CAST("origBytes" - "origBytes" % 10 AS VARCHAR) AS o, CAST("respBytes" - "respBytes" % 10 AS VARCHAR) AS r FROM flows),
        d1 AS (SELECT o, n, sum(n) OVER (ORDER BY n DESC, o ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER () AS total FROM (SELECT o, count(*) AS n FROM o GROUP BY 1)),
        d2 AS (SELECT o, r, n, sum(n) OVER (PARTITION BY o ORDER BY n DESC, r ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER (PARTITION BY o) AS total FROM (SELECT o, r, count(*) AS n FROM o GROUP BY 1, 2)),
        s1 AS (SELECT edge, d1.o FROM (SELECT edge, {_RANDOM.format(key=f"'{SEED}|origBytes|' || edge")} % (SELECT max(total) FROM d1) AS u FROM e) x JOIN d1 ON x.u >= d1.hi - d1.n AND x.u < d1.hi),
        t AS (SELECT o, max(total) AS total FROM d2 GROUP BY 1)
        SELECT edge, x.o AS "origBytes", d2.r AS "respBytes" FROM (SELECT edge, s1.o, {_RANDOM.format(key=f"'{SEED}|respBytes|' || edge")} % t.total AS u FROM s1 JOIN t USING (o)) x
        JOIN d2 ON d2.o = x.o AND x.u >= d2.hi - d2.n AND x.u < d2.hi""",
    "pagerank": _pagerank_sql(5),
    "pagerank_step": f"""WITH {_hops_sql()}, b AS (SELECT src AS a, dst AS b FROM hops UNION ALL SELECT dst, src FROM hops), o AS (SELECT a, count(*) AS k FROM b GROUP BY 1)
        SELECT hv.id, round(coalesce(sum(1.0 / o.k), 0) / (SELECT count(*) FROM hv), 9) AS rank FROM hv LEFT JOIN b ON b.b = hv.id LEFT JOIN o ON o.a = b.a GROUP BY 1""",
    "connected_components": f"WITH RECURSIVE {_hops_sql()}, r(id, x) AS (SELECT id, id FROM hv UNION SELECT r.id, e.dst FROM r JOIN both_ways e ON e.src = r.x) SELECT id, min(x) AS component FROM r GROUP BY 1",
    "component_representatives": f"WITH RECURSIVE {_hops_sql()}, r(id, x) AS (SELECT id, id FROM hv UNION SELECT r.id, e.dst FROM r JOIN both_ways e ON e.src = r.x) SELECT DISTINCT min(x) AS component FROM r GROUP BY id",
    "strongly_connected_components": f"""WITH RECURSIVE {_hops_sql()}, r(id, x) AS (SELECT id, id FROM hv UNION SELECT r.id, e.dst FROM r JOIN simple e ON e.src = r.x)
        SELECT a.id, min(a.x) AS component FROM r a JOIN r b ON a.id = b.x AND a.x = b.id GROUP BY 1""",
    "triangle_count": f"""WITH {_hops_sql()}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM both_ways a JOIN both_ways b ON a.dst = b.src AND a.src < a.dst AND b.src < b.dst JOIN both_ways c ON c.src = a.src AND c.dst = b.dst)
        SELECT hv.id, count(t.x) AS triangles FROM hv LEFT JOIN t ON hv.id IN (t.x, t.y, t.z) GROUP BY 1""",
    "directed_triangles": f"WITH {_hops_sql()} SELECT a.src AS id, count(*) AS triangles FROM simple a JOIN simple b ON a.dst = b.src JOIN simple c ON b.dst = c.src AND c.dst = a.src GROUP BY 1",
    "bfs": _path_sql("simple"),
    "bfs_undirected": _path_sql("both_ways"),
    "sssp": _LEVELS.format(hops=_hops_sql(), links="simple") + " SELECT b.id, b.dist::INT AS dist, (SELECT min(p.id) FROM best p JOIN simple e ON e.src = p.id WHERE e.dst = b.id AND p.dist = b.dist - 1) AS parent FROM best b",
    "sssp_undirected": _LEVELS.format(hops=_hops_sql(), links="both_ways") + " SELECT id, dist::INT AS dist FROM best",
    "closeness": _LEVELS.format(hops=_hops_sql(), links="simple") + " SELECT round(coalesce((SELECT count(*) FROM hv) / nullif(sum(dist), 0), -1.0), 6) AS closeness FROM best",
    "harmonic_closeness": f"WITH {_hops_sql()} SELECT src AS id, count(*)::DOUBLE AS closeness FROM both_ways GROUP BY 1",
    "betweenness": f"""WITH {_hops_sql()}, two AS (SELECT a.src AS s, a.dst AS v, b.dst AS t FROM both_ways a JOIN both_ways b ON a.dst = b.src AND a.src <> b.dst
            WHERE NOT EXISTS (SELECT 1 FROM both_ways c WHERE c.src = a.src AND c.dst = b.dst)),
        n AS (SELECT s, t, count(*) AS k FROM two GROUP BY 1, 2)
        SELECT hv.id, round(coalesce(sum(1.0 / n.k), 0), 6) AS bc FROM hv LEFT JOIN two ON two.v = hv.id LEFT JOIN n ON n.s = two.s AND n.t = two.t GROUP BY 1""",
    "betweenness_3": f"""WITH {_hops_sql()},
        one AS (SELECT DISTINCT src AS s, dst AS t FROM both_ways),
        two AS (SELECT a.src AS s, a.dst AS v, b.dst AS t FROM both_ways a JOIN both_ways b ON a.dst = b.src AND a.src <> b.dst
            WHERE NOT EXISTS (SELECT 1 FROM one c WHERE c.s = a.src AND c.t = b.dst)),
        three AS (SELECT a.src AS s, a.dst AS v, b.dst AS w, c.dst AS t FROM both_ways a JOIN both_ways b ON a.dst = b.src JOIN both_ways c ON b.dst = c.src
            WHERE a.src <> c.dst AND NOT EXISTS (SELECT 1 FROM one x WHERE x.s = a.src AND x.t = c.dst) AND NOT EXISTS (SELECT 1 FROM two x WHERE x.s = a.src AND x.t = c.dst)),
        n2 AS (SELECT s, t, count(*) AS k FROM two GROUP BY 1, 2), n3 AS (SELECT s, t, count(*) AS k FROM three GROUP BY 1, 2),
        shares AS (
            SELECT v AS id, 1.0 / k AS x FROM two JOIN n2 USING (s, t)
            UNION ALL SELECT v, 1.0 / k FROM three JOIN n3 USING (s, t)
            UNION ALL SELECT w, 1.0 / k FROM three JOIN n3 USING (s, t))
        SELECT hv.id, round(coalesce(sum(x), 0), 6) AS bc FROM hv LEFT JOIN shares ON shares.id = hv.id GROUP BY 1""",
    "harmonic_closeness_reach": f"""WITH RECURSIVE {_hops_sql()},
        reach(s, id, dist) AS (SELECT id, id, 0 FROM hv UNION SELECT r.s, e.dst, r.dist + 1 FROM reach r JOIN both_ways e ON e.src = r.id WHERE r.dist < 40),
        best AS (SELECT s, id, min(dist) AS dist FROM reach GROUP BY 1, 2)
        SELECT s AS id, round(sum(1.0 / dist), 6) AS closeness FROM best WHERE dist > 0 GROUP BY 1""",
    "strong_representatives": f"""WITH RECURSIVE {_hops_sql()}, r(id, x) AS (SELECT id, id FROM hv UNION SELECT r.id, e.dst FROM r JOIN simple e ON e.src = r.x)
        SELECT DISTINCT component FROM (SELECT a.id, min(a.x) AS component FROM r a JOIN r b ON a.id = b.x AND a.x = b.id GROUP BY 1)""",
    "isomorphism_cycle": f"WITH {_hops_sql()} SELECT a.src AS p1, b.src AS p2, c.src AS p3 FROM simple a JOIN simple b ON a.dst = b.src JOIN simple c ON b.dst = c.src AND c.dst = a.src",
    "isomorphism_path": f"WITH {_hops_sql()} SELECT a.src AS p1, a.dst AS p2, b.dst AS p3 FROM simple a JOIN simple b ON a.dst = b.src AND a.src <> b.dst",
    "isomorphism_rows": f"""WITH {_hops_sql()}, c AS (SELECT a.src AS p1, b.src AS p2, c.src AS p3 FROM simple a JOIN simple b ON a.dst = b.src JOIN simple c ON b.dst = c.src AND c.dst = a.src)
        SELECT md5(p1 || ',' || p2 || ',' || p3) AS subgraph, unnest([1, 2, 3])::BIGINT AS pattern_id, unnest([p1, p2, p3]) AS target_id FROM c""",
    "degree_veracity": _veracity_sql("both"),
    "in_degree_veracity": _veracity_sql("in"),
    "out_degree_veracity": _veracity_sql("out"),
    "conn_log": f"""WITH {_FLOWS} SELECT 10 * 16777216 + src % 16777216 AS src, 10 * 16777216 + dst % 16777216 AS dst, ts, "origPort", "respPort", proto,
            CASE WHEN "respPkts" % 5 = 0 THEN 0 ELSE 0.5 END::DOUBLE AS duration, "origBytes", CASE WHEN "respPkts" % 3 = 0 THEN 0 ELSE "respBytes" END AS "respBytes",
            CASE WHEN "connState" = 'S0' THEN 'UNKNOWN' ELSE "connState" END AS "connState", "origPkts", "origIpBytes", "respPkts", "respIpBytes"
        FROM flows WHERE "origBytes" % 11 <> 0 AND "origBytes" % 7 <> 0""",
    "edges_as_text": f"WITH {_FLOWS} SELECT 'Edge(' || src || ',' || dst || ',null)' AS value FROM flows",
    "property_edges_as_text": f"""WITH {_FLOWS} SELECT 'Edge(' || concat_ws(',', src, dst) || ',EdgeData(' || concat_ws(',', {', '.join(f'"{n}"' for n in PROPERTIES)}) || '))' AS value FROM flows""",
    "stored_graph": f"WITH {_FLOWS} SELECT * FROM flows",
    "stored_text_graph": f"WITH {_FLOWS} SELECT * FROM flows",
    "import_files": f"""WITH {_FLOWS} SELECT 'nodes_header' AS file, ':ID,:LABEL' AS line
        UNION ALL SELECT 'relationships_header', ':START_ID,:END_ID,:TYPE,ts:long,origPort:int,respPort:int,proto:string,duration:double,origBytes:long,respBytes:long,connState:string,origPkts:long,origIpBytes:long,respPkts:long,respIpBytes:long'
        UNION ALL SELECT 'nodes', id || ',Node' FROM v
        UNION ALL SELECT 'relationships', concat_ws(',', src, dst, 'EDGE', {', '.join(f'"{n}"' for n in PROPERTIES)}) FROM flows""",
    "merged_parts": f"""WITH {_FLOWS} SELECT concat_ws(',', src, dst, 'EDGE', {', '.join(f'"{n}"' for n in PROPERTIES)}) AS line FROM flows""",
    "degree_pairs": f"WITH {_FLOWS} SELECT id || ',' || count(*) AS line FROM (SELECT src AS id FROM flows UNION ALL SELECT dst FROM flows) GROUP BY id",
    "degree_veracity_compat": _compat_sql(),
    "kronecker_links": _kronecker_sql(8),
}
