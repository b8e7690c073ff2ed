"""Empirical distributions of edge properties, and sampling from them.

One table holds all of them: (dist, cond, value, n, total, cum_lo, cum_hi), values as
text, counts as integers, ordered by falling count and then value. Probabilities are
n / total; sampling compares integers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalar import bucketed, random_long
from netloom.plans.graph import EDGE_FIELDS, PropertyGraph
from netloom.plans.iterate import cut

UNCONDITIONAL = ["ts", "origPort", "respPort", "origBytes"]
CONDITIONAL = ["proto", "duration", "respBytes", "connState", "origPkts", "origIpBytes", "respPkts", "respIpBytes"]
BUCKETED = ["ts", "duration", "origBytes", "respBytes", "origPkts", "origIpBytes", "respPkts", "respIpBytes"]
CELL_VALUES, MIN_CELLS = 4, 64


def bucket_properties(edges: DataFrame, width: int = 10) -> DataFrame:
    return edges.select(*[bucketed(F.col(c), width).alias(c) if c in BUCKETED else c for c in edges.columns])


def _cumulated(counts: DataFrame) -> DataFrame:
    """Running sums of (dist, cond, value, n) in order of falling n.

    All rows are cut in ranges of (dist, cond, n, value), so that a distribution of very
    many values is no single task's: sums run inside a range, and a distribution that
    spans several ranges adds the sums of those before.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("n"), F.col("value")]
    ranged = cut(counts.repartitionByRange(parts, "dist", F.col("cond").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id()), "ranged")
    local = Window.partitionBy("part", "dist", "cond").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = Window.partitionBy("dist", "cond")  # a row for each range that the distribution spans
    sums = ranged.groupBy("part", "dist", "cond").agg(F.sum("n").alias("here"))
    sums = sums.select("part", "dist", "cond", F.sum("here").over(of).alias("total"), (F.sum("here").over(of.orderBy("part")) - F.col("here")).alias("before"))
    r, s = ranged.withColumn("run", F.sum("n").over(local)).alias("r"), sums.alias("s")
    same = (F.col("r.part") == F.col("s.part")) & (F.col("r.dist") == F.col("s.dist")) & F.col("r.cond").eqNullSafe(F.col("s.cond"))
    high = F.col("before") + F.col("run")
    return r.join(s, same).select("r.dist", "r.cond", "value", "n", "total", high.alias("cum_hi"), (high - F.col("n")).alias("cum_lo"))


def distribution(values: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """The distribution of one column."""
    counts = values.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return _cumulated(counts.select(F.lit(name or column).alias("dist"), F.lit(None).cast("string").alias("cond"), "value", "n"))


def conditional_distribution(values: DataFrame, column: str, cond: str, name: str | None = None) -> DataFrame:
    """The distributions of ``column`` for each value of ``cond``."""
    counts = values.groupBy(F.col(cond).cast("string").alias("cond"), F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return _cumulated(counts.select(F.lit(name or column).alias("dist"), "cond", "value", "n"))


def multiplicity(g: PropertyGraph) -> DataFrame:
    """(n, pairs): how many vertex pairs have n parallel edges."""
    return g.merged().groupBy("n").agg(F.count("*").alias("pairs"))


def data_distributions(g: PropertyGraph, width: int = 10) -> DataFrame:
    """All fourteen distributions from one pass over the edges."""
    edges = bucket_properties(g.edges, width)
    cells = [F.struct(F.lit(c).alias("dist"), F.lit(None).cast("string").alias("cond"), F.col(c).cast("string").alias("value")) for c in UNCONDITIONAL]
    cells += [F.struct(F.lit(c).alias("dist"), F.col("origBytes").cast("string").alias("cond"), F.col(c).cast("string").alias("value")) for c in CONDITIONAL]
    counts = edges.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.dist", "x.cond", "x.value").agg(F.count("*").alias("n"))
    pairs = multiplicity(g)
    both = F.explode(F.array(F.lit("inDegree"), F.lit("outDegree"))).alias("dist")
    degrees = pairs.select(both, F.lit(None).cast("string").alias("cond"), F.col("n").cast("string").alias("value"), F.col("pairs").alias("n"))
    return _cumulated(counts.select("dist", "cond", "value", "n").unionByName(degrees))


def sample(rows: DataFrame, key: str, dists: DataFrame, dist: str, seed: int, cond: str | None = None, into: str | None = None) -> DataFrame:
    """``rows`` with a value drawn from ``dist`` for each; a row whose condition is unknown gets null.

    The cumulative table is cut in cells, so that the lookup is an equi-join on
    (condition, cell) with a short range check. A distribution of D values has at least
    D / CELL_VALUES cells of equal probability, so a drawn row meets CELL_VALUES + 1
    values on average, however many there are.
    """
    into = into or dist
    d = dists.where(F.col("dist") == dist).select(F.coalesce("cond", F.lit("")).alias("__cond"), F.col("value").alias("__value"), "total", "cum_lo", "cum_hi")
    sizes = d.groupBy("__cond").agg(F.max("total").alias("total"), F.count("*").alias("__values"))
    cells = F.greatest(F.ceil(F.col("__values") / CELL_VALUES), F.least(F.col("total"), F.lit(MIN_CELLS)))
    sizes = sizes.select("__cond", "total", F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / cells)).alias("__width"))
    cell = lambda c: F.floor(c / F.col("__width")).cast("long")
    d = d.join(sizes.select("__cond", "__width"), "__cond").withColumn("__cell", F.explode(F.sequence(cell(F.col("cum_lo")), cell(F.col("cum_hi") - 1))))
    keyed = rows.withColumn("__cond", F.coalesce(F.col(cond).cast("string"), F.lit("")) if cond else F.lit(""))
    drawn = keyed.join(sizes, "__cond", "left").withColumn("__u", F.pmod(random_long(seed, dist, F.col(key)), F.col("total"))).withColumn("__cell", cell(F.col("__u")))
    cells = d.select("__cond", "__cell", "__value", "cum_lo", "cum_hi")
    found = drawn.join(cells, ["__cond", "__cell"], "left").where("cum_lo is null or (__u >= cum_lo and __u < cum_hi)")
    return found.select(*rows.columns, F.col("__value").alias(into))


def generate_properties(links: DataFrame, dists: DataFrame, seed: int = 7) -> DataFrame:
    """Links (src, dst, edge) with drawn properties; eight of them depend on the drawn origBytes."""
    kinds = dict(EDGE_FIELDS)
    rows = links.select("src", "dst", "edge")
    for name in UNCONDITIONAL:
        rows = sample(rows, "edge", dists, name, seed)
    for name in CONDITIONAL:
        rows = sample(rows, "edge", dists, name, seed, cond="origBytes")
    return rows.select("src", "dst", *[F.col(n).cast(t).alias(n) for n, t in kinds.items()])
