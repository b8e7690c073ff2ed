"""Logs, storage, distributions, synthesis, the command line and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom import cli, metrics, queries
from netloom.functions import scalar as S
from netloom.metrics import Timer, executor_metrics, graphite_lines
from netloom.operators import distributions as D
from netloom.operators import kronfit
from netloom.operators import synthesis as Y
from netloom.operators.kronfit import fit_kronecker
from netloom.plans.graph import PropertyGraph
from netloom.sources import graphs as G
from netloom.sources.connlog import parse_lines
from netloom.streaming.seed import flow_counts, save_stream, stream_edges

ROW = "1318226897.5\tu\t1.2.3.4\t68\t5.6.7.8\t67\tudp\t-\t0.25\t116\t-\tsf\t-\t-\t0\tDd\t2\t172\t2\t286\t(empty)"
LOG = ["#fields\tts", "", ROW, ROW.replace("udp", "tcp").replace("sf", "odd"), ROW.replace("udp", "icmp"), ROW.replace("1.2.3.4", "fe80::1"), "short\tline"]


@pytest.fixture(scope="module")
def edges(spark):
    return parse_lines(spark.createDataFrame([(x,) for x in LOG], "value string"))


def test_log(edges):
    got = sorted(map(tuple, edges.collect()), key=lambda r: r[5])
    udp = (0x01020304, 0x05060708, 1318226897, 68, 67, "UDP", 0.25, 116, 0, "SF", 2, 172, 2, 286)
    assert got == [(*udp[:5], "TCP", 0.25, 116, 0, "UNKNOWN", 2, 172, 2, 286), udp]


def test_bucketing(spark):
    df = spark.createDataFrame([(17, 1.0)], "a long, b double")
    assert df.select(S.bucketed(F.col("a"), 10), S.bucketed(F.col("a"), 0)).first() == (10, 17)


def test_round_trips(spark, edges, tmp_path):
    g = PropertyGraph.of_edges(edges)
    p = f"{tmp_path}/g"
    G.save_graph(g, p)
    assert sorted(map(tuple, G.load_graph(spark, p, 1).edges.collect())) == sorted(map(tuple, edges.collect()))
    with pytest.raises(Exception, match="exists"):
        G.save_graph(g, p)
    G.save_text(g, p, True)
    again = G.load_text(spark, p)
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, edges.collect()))
    assert again.vertices.count() == 2
    G.save_import_csv(g, p, True)
    assert spark.read.text(f"{p}_relationships").where("value like '%EDGE%UDP%'").count() == 1
    assert spark.read.text(f"{p}_relationships_header").first()[0].startswith(":START_ID,:END_ID,:TYPE,ts:long,origPort:int")
    G.merge_parts(spark, f"{p}_edges_text", f"{p}.txt")
    assert len(open(f"{p}.txt").read().splitlines()) == 2
    with pytest.raises(NotImplementedError):
        G.LOADERS["neo4j"](spark, p)


def test_matrix(spark, tmp_path):
    (tmp_path / "m").write_text("0.9  0.5\n0.5\t0.1\n")
    assert G.load_matrix(spark, str(tmp_path / "m")) == [[0.9, 0.5], [0.5, 0.1]]


def test_sampling_follows_the_distribution(spark):
    values = spark.createDataFrame([(v, c) for c in (1, 2) for v in "aaaabbc"] + [("d", 2)] * 7, "v string, c long")
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2 + 1).alias("c"))
    one = D.sample(rows, "k", D.distribution(values, "v"), "v", 3)
    got = {r[0]: r[1] / 200_000 for r in one.groupBy("v").count().collect()}
    assert all(abs(got[v] - n / 21) < 0.01 for v, n in {"a": 8, "b": 4, "c": 2, "d": 7}.items())
    two = D.sample(rows, "k", D.conditional_distribution(values, "v", "c"), "v", 3, cond="c")
    got = {(r[0], r[1]): r[2] / 100_000 for r in two.groupBy("c", "v").count().collect()}
    assert abs(got[1, "a"] - 4 / 7) < 0.01 and abs(got[2, "d"] - 0.5) < 0.01 and (1, "d") not in got


def test_unknown_condition_draws_null(spark):
    values = spark.createDataFrame([("a", 1)], "v string, c long")
    rows = spark.createDataFrame([("k", 5)], "k string, c long")
    assert D.sample(rows, "k", D.conditional_distribution(values, "v", "c"), "v", 3, cond="c").first()["v"] is None


def test_synthesis_is_reproducible(spark, edges):
    g = PropertyGraph.of_edges(edges.unionByName(edges))
    dists = D.data_distributions(g)
    a, b = (sorted(map(tuple, Y.barabasi_albert(g, dists, 2, 0.5, seed=5).collect())) for _ in range(2))
    assert a == b and len(a) >= 4
    k = Y.kronecker_links(spark, [[0.9, 0.5], [0.5, 0.1]], 5, seed=1)
    assert k.count() == 32 and k.distinct().count() == 32 and k.agg(F.max(F.greatest("src", "dst"))).first()[0] < 32
    made = Y.synthesize(g, "kro", dists=dists, matrix=[[0.9, 0.5], [0.5, 0.1]], iterations=4)
    assert made.edges.columns == edges.columns and made.edges.where("proto is null").count() == 0
    with pytest.raises(ValueError):
        Y.kronecker_links(spark, [[2.0, 0.0], [0.0, 0.0]], 5)


def test_kronecker_fit_raises_the_likelihood(spark):
    links = Y.kronecker_links(spark, [[0.95, 0.6], [0.6, 0.2]], 7, seed=3)
    g = PropertyGraph.of_edges(links)
    before = fit_kronecker(g, iterations=1, warm_up=0, samples=0, rate=0.0, start=(0.6, 0.6, 0.6, 0.6)).first()["log_likelihood"]
    after = fit_kronecker(g, iterations=30, warm_up=2_000, samples=2_000, rate=1e-4, start=(0.6, 0.6, 0.6, 0.6)).first()["log_likelihood"]
    assert after > before


def test_kronecker_fit_walks_in_full_each_iteration(spark, monkeypatch):
    r = np.random.default_rng(4)
    edges = np.unique(np.concatenate([r.integers(0, 20, (60, 2)), [[3, 3]]]), axis=0)
    theta = np.array([[0.9, 0.6], [0.5, 0.2]])

    def brute(place, k):
        digits = np.array([[sum(((place[a] >> d) & 1) * 2 + ((place[b] >> d) & 1) == c for d in range(k)) for c in range(4)] for a, b in edges])
        p = np.exp(digits @ np.log(theta).ravel())
        s, s2 = theta.sum(), (theta**2).sum()
        grad = -k * s ** (k - 1) - k * s2 ** (k - 1) * theta.ravel() + (1 + p + p * p) @ digits / theta.ravel()
        return -(s**k) - 0.5 * s2**k + (np.log(p) + p + 0.5 * p * p).sum(), grad

    one, all_ = (kronfit._Chain(edges, 20, theta, np.random.default_rng(5)) for _ in range(2))
    states = []
    for chain in (one, all_):
        assert np.isclose(chain.value, brute(chain.place, chain.k)[0])
    for _ in range(300):
        one.walk(1)
        states.append(brute(one.place, one.k))
        assert np.isclose(one.value, states[-1][0]) and np.allclose(one.grad, states[-1][1])
    assert len({round(v, 6) for v, _ in states}) > 20
    start = list(all_.place)
    monkeypatch.setattr(all_, "rng", _Recorded(np.random.default_rng(6)))
    value, grad = all_.walk(300)
    seen = _replay(all_, edges, start, brute)
    assert np.isclose(value, np.mean([v for v, _ in seen])) and np.allclose(grad.ravel(), np.mean([g for _, g in seen], 0))

    steps = []
    monkeypatch.setattr(kronfit._Chain, "walk", lambda self, n, walk=kronfit._Chain.walk: (steps.append(n), walk(self, n))[1])
    g = PropertyGraph.of_edges(spark.createDataFrame(edges.tolist(), "src long, dst long"))
    fit_kronecker(g, iterations=3, warm_up=50, samples=70)
    assert steps == [50, 70] * 3


class _Recorded:
    """A generator that keeps what it drew."""

    def __init__(self, rng):
        self.rng, self.drawn = rng, []

    def integers(self, *args):
        self.drawn.append(self.rng.integers(*args))
        return self.drawn[-1]

    def random(self, n):
        self.drawn.append(self.rng.random(n))
        return self.drawn[-1]


def _replay(chain, edges, place, brute):
    """Value and gradient after each step of a walk, from the numbers it drew."""
    at, coin, ends, u = chain.rng.drawn
    place, seen = list(place), []
    for e, c, (i, j), x in zip(at, coin, ends, u, strict=True):
        i, j = (i, j) if c < 0.2 else edges[e]
        before = brute(place, chain.k)
        place[i], place[j] = place[j], place[i]
        after = brute(place, chain.k)
        if i == j or not np.isin(edges, (i, j)).any() or np.log(x) > after[0] - before[0]:
            place[i], place[j] = place[j], place[i]
            after = before
        seen.append(after)
    return seen


def test_kronecker_query_fits_with_the_defaults(monkeypatch):
    given = {}
    monkeypatch.setattr(kronfit, "fit_kronecker", lambda g, **kw: given.update(kw))
    monkeypatch.setattr(queries, "_hops", lambda s, d: None)
    queries.kronecker_fit(None, "")
    assert set(given) <= {"seed"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "log").write_text("\n".join(LOG * 3) + "\n")
    p = str(tmp_path)
    cli.main(["seed", f"{p}/log", "-g", f"{p}/g", "-d", f"{p}/d", "-b", "5"], spark)
    cli.main(["synth", "ba", "-g", f"{p}/g", "-d", f"{p}/d", "-o", f"{p}/s", "-i", "1", "-f", "0.9", "-x"], spark)
    cli.main(["workload", f"{p}/g", "degree", "count-edges"], spark)
    assert capsys.readouterr().out.count("[TIME]") == 4
    with pytest.raises(SystemExit):
        cli.main(["workload", f"{p}/g", "degree", "--nonsense"], spark)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(LOG) + "\n")
    q = save_stream(stream_edges(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    counts = flow_counts(stream_edges(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("flow_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("flow_counts").agg(F.sum("flows")).first()[0] == 2


def test_metrics(spark):
    timer = Timer()
    with timer.timed("x"):
        pass
    assert timer.frame(spark).count() == 1 and executor_metrics(spark).count() == 0
    assert graphite_lines([{"id": "1", "totalCores": 4, "hostPort": "h"}], 9) == ["spark.1.totalCores 4 9"]


def test_cli_savers_loaders_and_distributions(spark, tmp_path):
    p = str(tmp_path)
    lines = ["\t".join(["1.5", "u", f"10.0.0.{i % 7}", "1", f"10.0.1.{i % 5 if i % 2 else 0}", "2", "tcp", "-", "1", str(i % 3), "4", "SF", "-", "-", "0", "D", "1", "2", "3", "4"]) for i in range(80)]
    (tmp_path / "log").write_text("\n".join(lines))
    cli.main(["seed", f"{p}/log", "-g", f"{p}/g", "-d", f"{p}/d", "-w", "none", "-t", "spark"], spark)
    assert not (tmp_path / "g_edges").exists() and spark.read.text(f"{p}/g_edges_text").count() == 80
    cli.main(["synth", "ba", "-g", f"{p}/g", "-d", f"{p}/d", "-o", f"{p}/s", "-i", "1", "-f", "0.9", "-x", "-r", "text", "-w", "neo4j", "-t", "spark", "--metrics", "degree", "--csv", f"{p}/v"], spark)
    assert spark.read.text(f"{p}/s_relationships").count() > 80
    shares = [sum(float(r.value.split(",")[1]) for r in spark.read.text(f"{p}/v_degree_dist.{side}.csv").collect()) for side in ("g1", "g2")]
    assert all(abs(x - 1) < 1e-9 for x in shares)
    cli.main(["veracity", f"{p}/g", f"{p}/s", "-r", "text", "--metrics", "in-degree"], spark)
    with pytest.raises(SystemExit):
        cli.main(["workload", f"{p}/g", "degree", "--backend", "other"], spark)


def test_poll_sends_host_figures(spark):
    sent = []
    metrics.poll(spark, sent.extend, seconds=0.05, rounds=2)
    names = {x.split()[0].rpartition(".")[2] for x in sent}
    assert set(metrics.HOST_FIELDS) <= names and all(len(x.split()) == 3 for x in sent)
    row = metrics.host_metrics(spark, 0.05).first()
    assert abs(row.cpuUsage + row.cpuIdle - 100) < 1e-6 and 0 < row.memoryAvailable <= row.memoryTotal


def test_poisson_bounds_reach_the_last_draw():
    for mean in (0.0, 0.1, 1.0, 20.0, 100.0):
        bounds = Y.poisson_bounds(mean)
        assert bounds == sorted(bounds) and all(0 <= x < 1 for x in bounds)
        mean_of = sum(1 - x for x in bounds)  # E N = sum of P(N >= k)
        assert abs(mean_of - mean) < 1e-9 * max(1, mean)
        assert not bounds or bounds[-1] > 1 - 1e-12
