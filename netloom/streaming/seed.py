"""Streaming ingest of connection logs: the batch parser on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.sources.connlog import parse_lines


def stream_edges(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def flow_counts(edges: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, proto, flows, bytes) per window of event time; rows later than ``late`` are left out of open windows."""
    timed = edges.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", late)
    return timed.groupBy(F.window("time", window).alias("w"), "proto").agg(F.count("*").alias("flows"), F.sum(F.col("origBytes") + F.col("respBytes")).alias("bytes")).select(F.col("w.start").alias("start"), "proto", "flows", "bytes")


def save_stream(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return edges.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
