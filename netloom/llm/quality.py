"""Quality rules as a bitmask ledger, in SQL functions only.

``measure`` evaluates every measurement once per document; ``ledger`` turns them into
one long of failure bits, one bit per rule. Policies are named sets of rules with a
version: applying one is a bitwise AND, so that policies can be changed, compared and
ablated without reading a text again.

Edge cases: a null text has no words (and fails ``few_words``); runs of white space
only give no words; repeated rows are judged alike; an empty table gives an empty
table. Windows are told apart by a 64-bit hash within one text. ``quality_filter`` gives
the caller's columns back as they were, also ones named like the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import packed, unpacked

_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds a struct ``q`` of measurements to ``docs``, whose other columns stay.

    q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_caps,
    n_marks (all long).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    df = docs.withColumn("__words", words).withColumn("__lines", lines)
    n = F.size("__words")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__grams", grams)
    # (hash, position) in order, only for texts in which some window comes twice
    twice = F.size(F.array_distinct("__grams")) < F.size("__grams")
    df = df.withColumn("__pairs", F.when(twice, F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get(F.col("__pairs"), k)["h"]
    places = F.sort_array(F.transform(F.filter("__pairs", lambda x, k: F.coalesce(x["h"] == at(k - 1), F.lit(False)) | F.coalesce(x["h"] == at(k + 1), F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    q = F.struct(
        n.cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_caps"),
        F.regexp_count(text, F.lit(r"!")).cast("long").alias("n_marks"),
    )
    return df.withColumn("q", q).drop("__words", "__lines", "__grams", "__pairs")


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Column

    @property
    def mask(self) -> int:
        return 1 << self.bit


def rules() -> list[Rule]:
    """Bits never change their meaning; a new rule takes the next bit."""
    q = lambda name: F.col("q")[name]
    return [
        Rule("few_words", 0, q("n_words") < 20),
        Rule("repeats", 1, 100 * q("n_repeat_words") > 30 * q("n_words")),
        Rule("symbols", 2, 100 * q("n_symbols") > 20 * q("n_words")),
        Rule("shouting", 3, (100 * q("n_caps") > 50 * q("word_chars")) | (100 * q("n_marks") > 50 * q("n_words"))),
        Rule("long_words", 4, q("word_chars") > 20 * q("n_words")),
        Rule("duplicate_lines", 5, (q("n_lines") >= 4) & (100 * q("n_dup_lines") > 50 * q("n_lines"))),
    ]


BASE = ("few_words", "repeats")
#: name of a policy -> rules whose failure rejects a document
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "shouting", "long_words", "duplicate_lines"),
}
CURRENT = "v2"


def mask_of(names: tuple[str, ...]) -> int:
    by_name = {r.name: r.mask for r in rules()}
    return sum(by_name[n] for n in names)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with q (measurements) and fail_bits (long): each rule evaluated once."""
    bits = F.lit(0).cast("long")
    for rule in rules():
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(rule.mask)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text_col).withColumn("fail_bits", bits)


def passes(policy: str = CURRENT) -> Column:
    """True for ledger rows that a policy keeps."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: failed (documents), alone (rejected by it only)."""
    mask = mask_of(POLICIES[policy])
    chosen = [r for r in rules() if r.mask & mask]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    sums = rows.agg(
        *[F.sum((hit.bitwiseAND(F.lit(r.mask).cast("long")) != 0).cast("long")).alias(f"failed_{r.name}") for r in chosen],
        *[F.sum((hit == r.mask).cast("long")).alias(f"alone_{r.name}") for r in chosen],
    )
    cells = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.coalesce(f"failed_{r.name}", F.lit(0)).alias("failed"), F.coalesce(f"alone_{r.name}", F.lit(0)).alias("alone")) for r in chosen])
    return sums.select(F.inline(cells))


def quality_report(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """doc_id, the measurements, base_failed, kept and fail_bits for every row.

    Filters on the report stay above the ledger, as in quality_filter.
    """
    rows = ledger(docs.select(F.col("doc_id"), F.col("text")))
    rows = rows.withColumn("fail_bits", F.when(F.monotonically_increasing_id() >= 0, F.col("fail_bits")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    return rows.select(
        "doc_id", *[F.col("q")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "fail_bits",
    )


def quality_filter(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with their own columns.

    The row number keeps the optimizer from moving the filter below the ledger, where
    every use of a measurement would evaluate it anew.
    """
    rows, row = packed(docs, text=F.col("text"))
    rows = ledger(rows).withColumn("number", F.monotonically_increasing_id())
    return unpacked(rows.where(passes(policy) & (F.col("number") >= 0)), row, docs.columns)
