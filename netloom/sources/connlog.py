"""Connection logs: tab-separated lines, ``#`` comments, to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.plans.graph import PropertyGraph

#: Fixed: the log's column of each edge field.
COLUMNS = {"ts": 0, "src": 2, "origPort": 3, "dst": 4, "respPort": 5, "proto": 6, "duration": 8, "origBytes": 9, "respBytes": 10, "connState": 11, "origPkts": 16, "origIpBytes": 17, "respPkts": 18, "respIpBytes": 19}


def parse_lines(lines: DataFrame) -> DataFrame:
    """Edges of lines (value). Blank lines, comments, IPv6 and all but tcp and udp are left out.

    A line is parsed once, to a struct of text fields; missing ones are empty.
    """
    width = max(COLUMNS.values()) + 1
    fields = ", ".join(f"c{k} string" for k in range(width))
    kept = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    # generator output is a column of its own: no field parses the line anew
    kept = kept.select(F.inline(F.array(F.from_csv("value", fields, {"sep": "\t", "quote": "", "escape": "", "nullValue": "\u0000", "emptyValue": ""}))))
    at = {name: F.coalesce(F.col(f"c{k}"), F.lit("")) for name, k in COLUMNS.items()}
    kept = kept.where(S.is_ipv4(at["src"]) & S.is_ipv4(at["dst"]) & S.is_tcp_or_udp(at["proto"]))
    long = lambda n: S.number(at[n], "long").alias(n)
    return kept.select(
        S.ipv4_to_long(at["src"]).alias("src"), S.ipv4_to_long(at["dst"]).alias("dst"), S.whole_seconds(at["ts"]).alias("ts"), S.number(at["origPort"], "int").alias("origPort"), S.number(at["respPort"], "int").alias("respPort"),
        S.member(at["proto"], S.PROTOCOLS).alias("proto"), S.number(at["duration"], "double").alias("duration"), long("origBytes"), long("respBytes"), S.member(at["connState"], S.CONN_STATES).alias("connState"),
        long("origPkts"), long("origIpBytes"), long("respPkts"), long("respIpBytes"),
    )


def read_log(spark: SparkSession, path: str) -> PropertyGraph:
    return PropertyGraph.of_edges(parse_lines(spark.read.text(path)))
