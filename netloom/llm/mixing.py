"""Mixing sources to target weights by capped water-filling.

Targets are weight * level, clamped at ``max_epochs`` times a source's size; the level
is raised by what the clamped sources leave until no source is above its cap. A
source's ratio target/size says how often its documents are repeated whole; the
remaining fraction is taken from a seeded random order of its documents, the last of
them in part, so that each source's taken words equal its rounded target.

The random order is never sorted for a whole source: hashes fall in buckets, sums per
bucket find the one bucket in which the fraction ends, and only that bucket's documents
are ordered. There are ``BUCKETS`` of them, or one for each ``BUCKET_ROWS`` rows of the
table where that is more, so a bucket does not grow with the corpus.

Edge cases: null text has size 0; null sources form one source, last in order;
repeated rows are documents of their own; an empty table gives an empty table; if all
caps together are below the wanted total, every source stands at its cap.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import map_arrow, packed, shared_table, shuffle_partitions, text_bytes, unpacked

BUCKETS, BUCKET_ROWS = 1024, 100_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each text."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x.split()) for x in text_bytes(b.column(2))], pa.int64())], ["doc_id", "source", "size"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), batch, "doc_id long, source string, size long")


def ranked_sources(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, weight): weights go round by the sources' code-point order, null last.

    The order is a range partitioning with counts per range, not one task's sort.
    """
    n = shuffle_partitions(sizes.sparkSession)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = shared_table(totals.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "before")  # a row per partition
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    placed = ranged.withColumn("local", local).join(before, "part")
    at = (F.col("before") + F.col("local") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    return placed.select("source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds target to (source, source_size, weight). Each round is one sum over the sources."""
    cap = F.col("source_size") * float(max_epochs)
    free, level, seen = sources.agg(F.sum("weight")).first()[0] or 0.0, 0.0, -1
    level = total / free if free else 0.0
    while free:
        above = cap <= F.col("weight") * F.lit(level)
        n, capped, free = sources.agg(F.sum(above.cast("long")), F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == seen or not free:
            break
        seen, level = n, max(level, (total - capped) / free)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if free else cap)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, with_source: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    With ``with_source`` the source comes along. ``share``: the mix's words as a part of all words. ``taken``: words that the mix
    takes of the document, repeats counted; it is at most ceil(max_epochs) * size.
    """
    sizes = shared_table(word_counts(docs), "sizes")
    words, n = sizes.agg(F.sum("size"), F.count("*")).first()
    total, buckets = (words or 0) * share, max(BUCKETS, n // BUCKET_ROWS)
    targets = shared_table(water_fill(shared_table(ranked_sources(sizes, weights), "ranked"), total, max_epochs), "targets")
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("extra", goal - F.col("whole") * F.col("source_size"))

    order = F.xxhash64(F.lit(seed), "source", "doc_id")
    cells = sizes.withColumn("order", order).withColumn("cell", F.pmod("order", F.lit(buckets)))
    sums = cells.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    running = sums.withColumn("upto", F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    ends = (
        running.alias("r").join(plan.select("source", "extra").alias("p"), same("r", "p"))
        .where("upto > extra").groupBy("r.source").agg(F.min(F.struct("cell", (F.col("extra") - F.col("upto") + F.col("cell_size")).alias("left"))).alias("end"))
        .select("source", F.col("end.cell").alias("end_cell"), F.col("end.left").alias("left"))
    )
    plan = shared_table(
        plan.alias("p").join(ends.alias("e"), same("p", "e"), "left").select("p.*", F.coalesce("end_cell", F.lit(buckets).cast("long")).alias("end_cell"), F.coalesce("left", F.lit(0)).alias("left")), "plan"
    )
    rows = cells.alias("c").join(plan.alias("p"), same("c", "p")).select("doc_id", "size", "p.source", "source_size", "target", "whole", "order", "cell", "end_cell", "left")
    inside = rows.where("cell <> end_cell").withColumn("extra", F.when(F.col("cell") < F.col("end_cell"), F.col("size")).otherwise(0))
    w = Window.partitionBy("source").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("cell = end_cell").withColumn("upto", F.sum("size").over(w))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("upto") + F.col("size")))).drop("upto")
    return inside.unionByName(edge).select("doc_id", *["source"] * with_source, "size", "source_size", "target", (F.col("size") * F.col("whole") + F.col("extra")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged.

    A document that is taken in part (one of each source at most) keeps its first words,
    as many as are taken of its last copy. Rows that repeat id and source are taken
    alike, by the largest number of words taken of one of them.
    """
    taken = mix(docs, weights, share, max_epochs, seed, with_source=True)
    taken = taken.groupBy("doc_id", "source").agg(F.max(F.struct("taken", "size")).alias("x")).where("x.taken > 0 and x.size > 0")
    times = taken.select(F.col("doc_id").alias("at_id"), F.col("source").alias("at_source"), (F.col("x.taken") / F.col("x.size")).alias("times"), F.pmod("x.taken", "x.size").alias("rest"))
    rows, row = packed(docs, own_id=F.col("doc_id").cast("long"), own_source=F.col("source").cast("string"))
    rows = rows.join(times, F.col("own_id").eqNullSafe(F.col("at_id")) & F.col("own_source").eqNullSafe(F.col("at_source")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil("times").cast("int"))))
    text = F.col(f"{row}.text")
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    cut = F.when(F.col("copy") > F.col("times"), F.array_join(F.slice(words, F.lit(1), F.col("rest").cast("int")), " ")).otherwise(text)
    return unpacked(rows, row, docs.columns, text=cut)
