"""Connected and strongly connected components, triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.graph import PropertyGraph
from netloom.plans.iterate import cut, discard, place


def connected_components(g: PropertyGraph) -> DataFrame:
    """(id, component): the smallest id of the undirected component.

    Each round takes the smallest label around a vertex and then jumps to that label's
    own label, so the rounds grow with the logarithm of a path's length.
    """
    links = cut(g.undirected(), "links")
    labels = cut(g.vertices.select("id", F.col("id").alias("label")).distinct(), "labels")
    while True:
        around = links.join(labels, links.dst == labels.id).groupBy("src").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels.id == around.src, "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        lower = cut(lower, "lower")
        jump = lower.select(F.col("id").alias("at"), F.col("low").alias("next"))
        fresh = cut(lower.join(jump, lower.low == jump["at"]).select("id", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "labels")
        discard(labels)
        discard(lower)
        labels = fresh.select("id", "label")
        if fresh.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _reached(links: DataFrame, start: DataFrame, key: str, to: str) -> DataFrame:
    """(id, color) that ``start`` reaches along links inside one color. ``links`` carry color."""
    spark, k = links.sparkSession, 0
    folder, schema = place(spark, "reached"), start.select("id", "color").schema

    def put(rows: DataFrame) -> DataFrame:
        """A round's vertices in a folder of their own, none of which is written again."""
        path = f"{folder}/round={k}"
        rows.select("id", "color").write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    frontier = put(start)
    while not frontier.isEmpty():
        k += 1
        done = spark.read.schema(schema).parquet(folder).select("id", "color")
        step = frontier.join(links, (frontier.id == links[key]) & (frontier.color == links.color)).select(F.col(to).alias("id"), links.color).distinct()
        frontier = put(step.join(done, ["id", "color"], "left_anti"))
    return spark.read.schema(schema).parquet(folder).select("id", "color")


def strongly_connected_components(g: PropertyGraph, iterations: int | None = None) -> DataFrame:
    """(id, component): the smallest id of the strongly connected component.

    Rounds of trimming vertices without in- or out-links, spreading the smallest id
    forward as a color, and collecting backwards what reaches the color's root. After
    ``iterations`` rounds what is left stands alone.
    """
    if iterations is not None and iterations < 1:
        raise ValueError("iterations must be positive")
    every = cut(g.vertices.select("id").distinct(), "vertices")
    links, left, found, k = cut(g.simple(), "links"), every, [], 0
    while not links.isEmpty() and (iterations is None or k < iterations):
        k += 1
        while True:
            n = links.count()
            sources, sinks = links.select(F.col("src").alias("x")).distinct(), links.select(F.col("dst").alias("x")).distinct()
            both = sources.join(sinks, "x", "left_semi")
            links = cut(links.join(both, links.src == both.x, "left_semi").join(both, F.col("dst") == both.x, "left_semi"), "links")
            if links.count() == n:
                break
        if not n:
            break
        colors = cut(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("color", F.col("id")), "colors")
        while True:
            sent = links.join(colors, links.src == colors.id).groupBy("dst").agg(F.min("color").alias("low"))
            was = colors
            fresh = cut(colors.join(sent, colors.id == sent.dst, "left").select("id", F.least("color", F.coalesce("low", "color")).alias("color"), (F.col("low") < F.col("color")).alias("moved")), "colors")
            discard(was)
            colors = fresh.select("id", "color")
            if fresh.where("moved").isEmpty():
                break
        a, b = colors.select(F.col("id").alias("src"), F.col("color")), colors.select(F.col("id").alias("dst"), F.col("color").alias("other"))
        inside = cut(links.join(a, "src").join(b, "dst").where("color = other").select("src", "dst", "color"), "inside")
        back = _reached(inside, colors.where("id = color"), "dst", "src")
        found.append(back)
        links = cut(links.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "links")
    out = every.select("id", F.col("id").alias("component"))
    for back in found:
        at = back.select(F.col("id").alias("x"), "color")
        out = out.join(at, out.id == at.x, "left").select("id", F.coalesce("color", "component").alias("component"))
    return out


def representatives(components: DataFrame) -> DataFrame:
    """(component) of each component once."""
    return components.select("component").distinct()


def triangle_count(g: PropertyGraph) -> DataFrame:
    """(id, triangles) of the simple undirected graph; vertices without any have 0.

    Links point from lower to higher degree, so that no vertex, however many neighbours
    it has, opens more than the square root of twice the links.
    """
    both = cut(g.undirected(), "links")
    deg = both.groupBy("src").agg(F.count("*").alias("d"))
    a, b = deg.select(F.col("src"), F.col("d").alias("da")), deg.select(F.col("src").alias("dst"), F.col("d").alias("db"))
    up = cut(both.join(a, "src").join(b, "dst").where("struct(da, src) < struct(db, dst)").select("src", "dst"), "oriented")
    one, two = up.select(F.col("src").alias("x"), F.col("dst").alias("y")), up.select(F.col("src").alias("x"), F.col("dst").alias("z"))
    wedges = one.join(two, "x").where("y <> z")
    closing = up.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    corners = wedges.join(closing, ["y", "z"]).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return g.vertices.join(corners, "id", "left").select("id", F.coalesce("triangles", F.lit(0).cast("long")).alias("triangles"))


def directed_triangles(g: PropertyGraph) -> DataFrame:
    """(id, triangles): directed 3-cycles through a vertex, parallel edges counted.

    Corners are found on the undirected links from lower to higher degree, as in
    :func:`triangle_count`; each link carries its numbers of edges either way, and a
    closed triangle counts its two directions.
    """
    both = g.merged().where("src <> dst").select(F.explode(F.array(F.struct("src", "dst", F.col("n").alias("f"), F.lit(0).cast("long").alias("b")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).cast("long").alias("f"), F.col("n").alias("b")))).alias("e"))
    both = cut(both.groupBy("e.src", "e.dst").agg(F.sum("e.f").alias("f"), F.sum("e.b").alias("b")), "links")
    deg = both.groupBy("src").agg(F.count("*").alias("d"))
    a, b = deg.select(F.col("src"), F.col("d").alias("da")), deg.select(F.col("src").alias("dst"), F.col("d").alias("db"))
    up = cut(both.join(a, "src").join(b, "dst").where("struct(da, src) < struct(db, dst)").select("src", "dst", "f", "b"), "oriented")
    side = lambda x, y: up.select(F.col("src").alias(x), F.col("dst").alias(y), F.col("f").alias(f"f{x}{y}"), F.col("b").alias(f"b{x}{y}"))
    closed = side("x", "y").join(side("x", "z"), "x").join(side("y", "z"), ["y", "z"])
    cycles = F.col("fxy") * F.col("fyz") * F.col("bxz") + F.col("fxz") * F.col("byz") * F.col("bxy")
    return closed.select(F.explode(F.array("x", "y", "z")).alias("id"), cycles.alias("n")).groupBy("id").agg(F.sum("n").alias("triangles")).where("triangles > 0")
