"""Graphs, distributions, key-value pairs and matrices on storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.plans.graph import EDGE_FIELDS, PROPERTIES, PropertyGraph


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def save_graph(g: PropertyGraph, prefix: str, overwrite: bool = False) -> None:
    g.vertices.write.mode(_mode(overwrite)).parquet(f"{prefix}_vertices")
    g.edges.write.mode(_mode(overwrite)).parquet(f"{prefix}_edges")


def load_graph(spark: SparkSession, prefix: str, partitions: int | None = None) -> PropertyGraph:
    vertices, edges = spark.read.parquet(f"{prefix}_vertices"), spark.read.parquet(f"{prefix}_edges")
    if partitions:
        vertices, edges = vertices.coalesce(partitions), edges.coalesce(partitions)
    return PropertyGraph(vertices, edges)


def _has_properties(edges: DataFrame) -> bool:
    return set(PROPERTIES) <= set(edges.columns)


def edges_as_text(edges: DataFrame) -> DataFrame:
    """(value): Edge(src,dst,EdgeData(...)) lines; edges without properties, or all null, have null."""
    data = F.lit("null")
    if _has_properties(edges):
        known = F.coalesce(*[F.col(c).cast("string") for c in PROPERTIES]).isNotNull()
        filled = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PROPERTIES])
        data = F.when(known, F.concat(F.lit("EdgeData("), filled, F.lit(")"))).otherwise(data)
    return edges.select(F.concat(F.lit("Edge("), F.concat_ws(",", "src", "dst"), F.lit(","), data, F.lit(")")).alias("value"))


def save_text(g: PropertyGraph, prefix: str, overwrite: bool = False) -> None:
    g.vertices.select(F.concat(F.lit("("), F.col("id").cast("string"), F.lit(",null)")).alias("value")).write.mode(_mode(overwrite)).text(f"{prefix}_vertices_text")
    edges_as_text(g.edges).write.mode(_mode(overwrite)).text(f"{prefix}_edges_text")


def load_text(spark: SparkSession, prefix: str) -> PropertyGraph:
    ids = spark.read.text(f"{prefix}_vertices_text").select(F.regexp_extract("value", r"^\((-?\d+),", 1).alias("id")).where("id <> ''")
    lines = spark.read.text(f"{prefix}_edges_text").where("value like 'Edge(%'")
    ends = [F.regexp_extract("value", r"^Edge\((-?\d+),(-?\d+),", k).cast("long") for k in (1, 2)]
    cells = F.split(F.regexp_extract("value", r"EdgeData\((.*?)\)\)$", 1), ",", -1)
    known = F.col("value").contains("EdgeData(")
    fields = [F.when(known, F.coalesce(F.get(cells, F.lit(k)).try_cast(t), F.lit(0).cast(t))).alias(n) for k, (n, t) in enumerate(EDGE_FIELDS)]
    return PropertyGraph(ids.select(F.col("id").cast("long").alias("id")), lines.select(ends[0].alias("src"), ends[1].alias("dst"), *fields))


def merge_parts(spark: SparkSession, folder: str, file: str, overwrite: bool = False) -> None:
    """The part files of a folder as one file, in order of their names, through Hadoop's file systems."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(folder), hadoop.fs.Path(file)
    fs, to = source.getFileSystem(conf), target.getFileSystem(conf)
    if to.exists(target) and not overwrite:
        raise FileExistsError(file)
    out = to.create(target, True)
    for status in sorted(fs.listStatus(source), key=lambda s: s.getPath().getName()):
        if status.getPath().getName().startswith("part-"):
            data = fs.open(status.getPath())
            hadoop.io.IOUtils.copyBytes(data, out, conf, False)
            data.close()
    out.close()


def save_import_csv(g: PropertyGraph, prefix: str, overwrite: bool = False, label: str = "Node") -> None:
    """Node and relationship files for a bulk import: headers and bodies apart."""
    spark, mode = g.edges.sparkSession, _mode(overwrite)
    kinds = {"bigint": "long", "int": "int", "double": "double", "string": "string"}
    header = [":START_ID", ":END_ID", ":TYPE"]
    if _has_properties(g.edges):
        header += [f"{n}:{kinds[t.simpleString()]}" for n, t in EDGE_FIELDS]
    columns = PROPERTIES if _has_properties(g.edges) else []
    spark.createDataFrame([(":ID,:LABEL",)], "value string").coalesce(1).write.mode(mode).text(f"{prefix}_nodes_header")
    spark.createDataFrame([(",".join(header),)], "value string").coalesce(1).write.mode(mode).text(f"{prefix}_relationships_header")
    g.vertices.select("id", F.lit(label).alias("label")).write.mode(mode).csv(f"{prefix}_nodes")
    g.edges.select("src", "dst", F.lit("EDGE").alias("type"), *columns).write.mode(mode).csv(f"{prefix}_relationships")


def _not_provided(*_args, **_kw):
    raise NotImplementedError("this backend can save import files only")


def save_pairs(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """key,value lines of a two-column frame."""
    df.write.mode(_mode(overwrite)).csv(path)


def save_distributions(dists: DataFrame, path: str, overwrite: bool = False) -> None:
    dists.write.mode(_mode(overwrite)).partitionBy("dist").parquet(path)


def load_distributions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_matrix(spark: SparkSession, path: str) -> list[list[float]]:
    """A small square matrix, a row a line, numbers apart by white space."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect()]
    rows = [[float(x) for x in line.split()] for line in "".join(lines).splitlines() if line.strip()]
    if any(len(r) != len(rows) for r in rows):
        raise ValueError("the matrix is not square")
    return rows


def noop(df: DataFrame) -> None:
    """Compute ``df`` and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


LOADERS: dict[str, Callable] = {"spark": load_graph, "text": load_text, "neo4j": _not_provided}
SAVERS: dict[str, Callable | None] = {"spark": save_graph, "text": save_text, "neo4j": save_import_csv, "none": None}
