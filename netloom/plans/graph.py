"""The property graph: two DataFrames, and graph views of relational tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edge properties and their types, in order.
EDGE_FIELDS = [
    ("ts", T.LongType()), ("origPort", T.IntegerType()), ("respPort", T.IntegerType()), ("proto", T.StringType()), ("duration", T.DoubleType()), ("origBytes", T.LongType()),
    ("respBytes", T.LongType()), ("connState", T.StringType()), ("origPkts", T.LongType()), ("origIpBytes", T.LongType()), ("respPkts", T.LongType()), ("respIpBytes", T.LongType()),
]
PROPERTIES = [name for name, _ in EDGE_FIELDS]
EDGE_SCHEMA = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), *[T.StructField(n, t) for n, t in EDGE_FIELDS]])


@dataclass(frozen=True)
class PropertyGraph:
    """A directed multigraph: vertices(id), edges(src, dst, properties)."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def of_edges(cls, edges: DataFrame) -> PropertyGraph:
        """Vertices are the ends of the edges."""
        return cls(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)

    @property
    def links(self) -> DataFrame:
        return self.edges.select("src", "dst")

    def simple(self) -> DataFrame:
        """Distinct directed links without loops."""
        return self.links.where("src <> dst").distinct()

    def undirected(self) -> DataFrame:
        """Each link of the simple undirected graph in both directions."""
        return self.links.where("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct()

    def merged(self) -> DataFrame:
        """Parallel edges merged: (src, dst, n)."""
        return self.links.groupBy("src", "dst").agg(F.count("*").alias("n"))

    def relabelled(self) -> PropertyGraph:
        """Vertices 0 to n - 1 by id; properties go. Ids are ranked range by range."""
        ids = dense_ids(self.vertices.select("id").distinct())
        a, b = ids.select(F.col("id").alias("src"), F.col("rank").alias("a")), ids.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
        edges = self.links.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        return PropertyGraph(ids.select(F.col("rank").alias("id")), edges)


def dense_ids(ids: DataFrame) -> DataFrame:
    """(id, rank): rank from 0 by id, from a range partitioning and counts per range."""
    from pyspark.sql import Window

    from netloom.plans.iterate import cut

    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ids.repartitionByRange(n, "id").withColumn("part", F.spark_partition_id()), "ids")
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "before")  # a row per partition
    local = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return ranged.withColumn("local", local).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("local") - 1).alias("rank"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(column: str):
    return F.col(column).cast("timestamp").cast("long")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and line items as a bipartite property multigraph."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey)
    long = lambda c: c.cast("long")
    quantity, price, mod = F.floor("l_quantity"), F.floor("l_extendedprice"), F.col("l_orderkey") % 100
    return joined.select(
        F.col("o_custkey").alias("src"), long(10_000_000 + F.col("l_suppkey")).alias("dst"), _epoch("l_shipdate").alias("ts"), (F.col("l_partkey") % 65536).cast("int").alias("origPort"),
        F.col("l_linenumber").cast("int").alias("respPort"), F.when(F.col("l_linestatus") == "F", "TCP").otherwise("UDP").alias("proto"), (F.col("l_discount") * 100).alias("duration"),
        long(quantity).alias("origBytes"), long(price).alias("respBytes"), F.when(F.col("l_returnflag") == "A", "SF").when(F.col("l_returnflag") == "N", "S0").otherwise("REJ").alias("connState"),
        long(F.col("l_linenumber")).alias("origPkts"), long(quantity * 40).alias("origIpBytes"), long(mod).alias("respPkts"), long(price + 20 * mod).alias("respIpBytes"),
    )


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive error events as a directed simple graph with cycles.

    The next event is the one of the next place in order of time; places are dense ranks
    found range by range, so no single task orders all events.
    """
    from pyspark.sql import Window

    from netloom.plans.iterate import cut

    events = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("u"), F.col("event_type").alias("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(events.repartitionByRange(n, "ts", "event_id").withColumn("part", F.spark_partition_id()), "events")
    w = Window.partitionBy("part").orderBy("ts", "event_id")
    # the last event of a range is followed by the first of the next range that has any: a row per partition
    edge = ranged.groupBy("part").agg(F.min(F.struct("ts", "event_id", "u", "t")).alias("head")).withColumn("next", F.lead("head").over(Window.orderBy("part"))).select("part", "next")
    rows = ranged.withColumn("u2", F.lead("u").over(w)).withColumn("t2", F.lead("t").over(w)).withColumn("last", F.lead("event_id").over(w).isNull()).join(F.broadcast(edge), "part")
    pick = lambda own, name: F.when(F.col("last"), F.col(f"next.{name}")).otherwise(F.col(own))
    linked = rows.select(F.col("u").alias("src"), pick("u2", "u").alias("dst"), "t", pick("t2", "t").alias("t2")).where("t = 'error' and t2 = 'error'")
    return linked.select("src", "dst").distinct()
