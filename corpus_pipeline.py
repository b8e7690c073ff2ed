"""A training-data pipeline: rules, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All stages but the last return the
columns of documents; the last returns a row per document copy with its token counts
and digests.

Every stage takes an empty table to an empty one, ignores columns beside doc_id, text and
source, and gives them back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm.bpe import bpe_digest
from netloom.llm.common import drop_table, shared_table, table
from netloom.llm.exact_dedup import exact_dedup
from netloom.llm.minhash import near_dedup
from netloom.llm.mixing import mix_documents
from netloom.llm.quality import quality_filter


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null, empty and blank texts have too few words and go.

    Rows are judged one by one: repeated rows stay or go together.
    """
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays, a null id before all others; of rows that repeat both, one.

    A null text equals an empty one.
    """
    return exact_dedup(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest id stays.

    Rows with a null id, and texts without words, are nobody's copy and stay; rows that
    repeat an id are judged by their own texts.
    """
    return near_dedup(docs, percent=75)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source in part.

    Texts without words are not taken; null sources are one source; ties of the seeded
    order go by id and size; rows that repeat id and source are taken alike.
    """
    return mix_documents(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, encoded and decoded again; null and empty texts have none."""
    return bpe_digest(docs)


STAGES = [("quality rules", rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("bpe", tokens)]

#: SQL can't express the seeded sampling or the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared_table(docs, f"stage{k}")
            if before is not None:
                drop_table(before)
            before = docs
    return docs
