"""Command line: seed, synth, veracity and workload."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from netloom.metrics import Timer
from netloom.operators import distributions, synthesis
from netloom.operators.veracity import METRICS, VALUES, histograms
from netloom.plans.graph import PropertyGraph
from netloom.plans.iterate import cut
from netloom.plans.workloads import WORKLOADS
from netloom.sources import graphs
from netloom.sources.connlog import read_log


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netloom")
    sub = p.add_subparsers(dest="mode", required=True)
    a = sub.add_parser("seed", help="a connection log to a graph and its distributions")
    a.add_argument("log")
    a.add_argument("-g", "--graph", default="seed")
    a.add_argument("-d", "--distributions", default="seed.dist")
    a.add_argument("-b", "--bucket-size", type=int, default=10)
    a = sub.add_parser("synth", help="a larger graph like a seed")
    a.add_argument("method", choices=["ba", "kro"])
    a.add_argument("-g", "--graph", default="seed")
    a.add_argument("-d", "--distributions", default="seed.dist")
    a.add_argument("-o", "--out", default="synth")
    a.add_argument("-i", "--iterations", type=int, required=True)
    a.add_argument("-f", "--fraction", type=float, default=0.1)
    a.add_argument("-m", "--matrix")
    a.add_argument("-x", "--exclude-properties", action="store_true")
    a.add_argument("-s", "--seed", type=int, default=42)
    a.add_argument("--metrics", nargs="*", default=[], choices=[*METRICS, "all"])
    a = sub.add_parser("veracity", help="distance of two graphs")
    a.add_argument("seed_graph")
    a.add_argument("synth_graph")
    a.add_argument("--metrics", nargs="*", default=["all"], choices=[*METRICS, "all"])
    a = sub.add_parser("workload", help="run named workloads")
    a.add_argument("graph")
    a.add_argument("names", nargs="*", default=["all"])
    a.add_argument("--iterations", type=int)
    a.add_argument("--source", type=int, default=0)
    a.add_argument("--target", type=int, default=0)
    a.add_argument("--pattern", help="edges as a-b,b-c")
    a.add_argument("--backend", choices=["spark"], default="spark", help="where workloads run")
    savers, loaders = [k for k in graphs.SAVERS if k != "text"], [k for k in graphs.LOADERS if k != "neo4j"]
    for name, q in sub.choices.items():
        q.add_argument("--overwrite", action="store_true")
        q.add_argument("-p", "--partitions", type=int, help="shuffle partitions, and the most partitions of a loaded graph")
        q.add_argument("--debug", action="store_true", help="log what Spark does")
        if name != "seed":
            q.add_argument("-r", "--loader", choices=loaders, default="spark")
        if name in ("seed", "synth"):
            q.add_argument("-w", "--saver", choices=savers, default="spark")
            q.add_argument("-t", "--as-text", choices=["spark", "none"], default="none", help="save the graph as text, too")
        if name in ("synth", "veracity"):
            q.add_argument("--csv", help="prefix of the compared distributions as key,value files")
    return p


def _load(spark: SparkSession, o: argparse.Namespace, prefix: str) -> PropertyGraph:
    g = graphs.LOADERS[o.loader](spark, prefix)
    return PropertyGraph(g.vertices.coalesce(o.partitions), g.edges.coalesce(o.partitions)) if o.partitions else g


def _save(g: PropertyGraph, o: argparse.Namespace, prefix: str) -> None:
    if graphs.SAVERS[o.saver]:
        graphs.SAVERS[o.saver](g, prefix, o.overwrite)
    if o.as_text == "spark":
        graphs.save_text(g, prefix, o.overwrite)


def _veracity(seed: PropertyGraph, synth: PropertyGraph, names: list[str], o: argparse.Namespace, timer: Timer) -> None:
    for name in _named(names, METRICS):
        with timer.timed(name):
            print(name, METRICS[name](seed, synth).first()[0])
            if o.csv:
                values, column = VALUES[name]
                for side, rows in zip(("g1", "g2"), histograms(values(seed), values(synth), column), strict=True):
                    graphs.save_pairs(rows, f"{o.csv}_{name}_dist.{side}.csv", o.overwrite)


def _named(asked: list[str], known: dict) -> list[str]:
    return list(known) if "all" in asked else asked


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[tuple[str, float]]:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("netloom").getOrCreate()
    if o.debug:
        spark.sparkContext.setLogLevel("INFO")
    if o.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(o.partitions))
    timer = Timer()
    if o.mode == "seed":
        with timer.timed("seed"):
            g = read_log(spark, o.log)
            g = PropertyGraph.of_edges(cut(g.edges, "seed"))  # the log is parsed once
            _save(g, o, o.graph)
            graphs.save_distributions(distributions.data_distributions(g, o.bucket_size), o.distributions, o.overwrite)
    elif o.mode == "synth":
        if o.method == "kro" and not o.matrix:
            raise SystemExit("kro needs --matrix")
        with timer.timed("synth"):
            g = _load(spark, o, o.graph)
            options = {"iterations": o.iterations} | ({"fraction": o.fraction} if o.method == "ba" else {"matrix": graphs.load_matrix(spark, o.matrix)})
            made = synthesis.synthesize(g, o.method, not o.exclude_properties, o.seed, graphs.load_distributions(spark, o.distributions), **options)
            _save(made, o, o.out)
        _veracity(g, made, o.metrics, o, timer)
    elif o.mode == "veracity":
        _veracity(_load(spark, o, o.seed_graph), _load(spark, o, o.synth_graph), o.metrics, o, timer)
    else:
        g = _load(spark, o, o.graph)
        pattern = [tuple(map(int, e.split("-"))) for e in o.pattern.split(",")] if o.pattern else [(1, 2), (2, 3), (3, 1)]
        options = {"source": o.source, "target": o.target, "pattern": pattern} | ({"iterations": o.iterations} if o.iterations else {})
        for name in _named(o.names, WORKLOADS):
            with timer.timed(name):
                graphs.noop(WORKLOADS[name](g, options))
    for name, seconds in timer.rows:
        print(f"[TIME] {name} {seconds:.3f}")
    return timer.rows


if __name__ == "__main__":
    main()
