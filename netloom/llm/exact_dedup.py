"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one id.

The shuffle key of a text is its 128-bit hash; the texts of a hash are told apart by
their bytes, because the aggregation groups by (hash, bytes). Partial aggregation
folds copies before the shuffle, so a text that a third of all rows repeat sends one
row per input task. Rows find their group again by hash alone; only hashes that more
than one text shares (a collision) are matched by bytes as well. Texts are lower-cased
and hashed in Arrow batches: SQL functions lower-case A-Z only by ``translate`` or by 26
calls of ``replace``, and with either the whole query took five times the CPU.

Edge cases: a null text is an empty text; a null id is below every other id; of rows
that repeat both id and text one stays; an empty table gives an empty table; the
caller's columns, whatever their names, come back as they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import map_arrow, packed, shared_table, skew_join, text_bytes, unpacked


def hash128(data: bytes) -> bytes:
    return hashlib.md5(data, usedforsecurity=False).digest()


def hashed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[bytes], bytes] = hash128, with_text: bool = True) -> DataFrame:
    """(doc_id, h128[, norm]): norm is the text's UTF-8 with A-Z lower-cased."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        norm = [x.lower() for x in text_bytes(b.column(1))]
        columns = [b.column(0), pa.array([hashed(x) for x in norm], pa.binary())]
        names = ["doc_id", "h128"]
        if with_text:
            columns.append(pa.array(norm, pa.binary()))
            names.append("norm")
        return pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, batch, "doc_id long, h128 binary" + ", norm binary" * with_text)


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[bytes], bytes] = hash128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``smallest`` or ``largest``: which id of a group of equal texts stays.
    """
    best: Column = {"smallest": F.min("doc_id"), "largest": F.max("doc_id")}[keep]
    if keep == "smallest":
        best = F.when(F.count("doc_id") == F.count("*"), best)  # a null id is the smallest
    rows = hashed_texts(docs, id_col, text_col, hashed)
    grouped = rows.groupBy("h128", "norm").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    texts = shared_table(grouped.select("h128", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "texts")
    collided = shared_table(texts.groupBy("h128").count().where("count > 1").select("h128"), "collided")
    slim, out = hashed_texts(docs, id_col, text_col, hashed, with_text=False), ["doc_id", "text_sha256", "keep_id", "group_size"]
    if collided.isEmpty():
        joined = skew_join(slim, texts, "h128", "group_size").select(*out)
    else:
        alone = skew_join(slim, texts.join(collided, "h128", "left_anti"), "h128", "group_size").select(*out)
        among = rows.join(collided, "h128", "left_semi")
        by_bytes = among.groupBy("h128", "norm").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        among = among.join(by_bytes, ["h128", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        joined = alone.unionByName(among.select(*out))
    # of rows that repeat a kept id and text, one stays
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return joined.withColumn("turn", turn).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    A document stays if its id and text are those kept. Two rows of one id with the
    same text count as one document; the first that Spark meets stays.
    """
    kept = exact_groups(docs, keep, id_col, text_col).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    rows, row = packed(docs, own_id=F.col(id_col).cast("long"), own_sha=_lower_sha(F.col(text_col)))
    joined = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha") == F.col("kept_sha")), "left_semi")
    repeated = joined.groupBy("own_id", "own_sha").count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        joined = joined.dropDuplicates(["own_id", "own_sha"])
    return unpacked(joined, row, docs.columns)


def _lower_sha(text: Column) -> Column:
    def sha(s: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256((x or "").encode().lower()).hexdigest() for x in s])

    return F.pandas_udf(sha, "string")(text)
