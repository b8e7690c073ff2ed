"""Clashing names, repeated rows, null ids, very long texts and empty tables, for every operator and stage."""

import collections
import hashlib
import random

import numpy as np
import pytest
from helpers import WORD, lower, remainder, texts, words
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import bpe, brown, chat, common, exact_dedup, minhash, mixing, quality, repeats, token_store, toxicity

#: Names that operators use inside, or used to.
CLASHING = (
    "q fail_bits number row __row __words __lines words n_words own_id own_source at_id at_source times rest copy __id __times __copy own_sha kept_id kept_sha keep_id h128 norm "
    "__sha __kept_id __gone k n bands root component_id label copies at value a.b size taken target kept"
).split()
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in texts(seed=11, n=60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return common.shared_table(df.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING]), "clashing")


@pytest.fixture(scope="module")
def labels(spark, docs):
    return common.shared_table(docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 2 as int) as toxic"), "labels")


def values(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("stage", [quality.quality_filter, exact_dedup.exact_dedup, minhash.near_dedup, mixing.mix_documents], ids=lambda f: f.__name__)
def test_columns_of_any_name_come_back_as_they_were(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns
    drop = ["text"] if stage is mixing.mix_documents else []  # the last copy of a source may be cut
    given, got = set(values(docs.drop(*drop))), set(values(out.drop(*drop)))
    assert got and got <= given
    plain = stage(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert values(out.select(plain.columns)) == values(plain)


def test_operators_ignore_other_columns(docs, labels):
    slim = docs.select("doc_id", "text", "source")
    for run in (bpe.bpe_digest, mixing.mix, quality.quality_report, lambda d: toxicity.toxicity(d, labels)):  # the others' tests do so
        assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(slim).collect()))


def test_repeated_rows(docs, labels):
    """Every row twice: each is answered for, and both copies alike where the contract does not tell them apart."""
    once = docs.select("doc_id", "text", "source")
    twice = once.unionByName(once)
    for run in (bpe.bpe_digest, quality.quality_report, lambda d: toxicity.toxicity(d, labels).select("doc_id", "held_out")):
        assert values(run(twice)) == {k: 2 * n for k, n in values(run(once)).items()}
    one = {r.doc_id: (r.n_tokens, r.held_out) for r in brown.brown_scores(once).collect()}
    got = brown.brown_scores(twice).collect()
    assert len(got) == 2 * len(one) and all((r.n_tokens, r.held_out) == one[r.doc_id] for r in got)
    near = lambda d: values(minhash.near_duplicates(d))
    assert near(twice) == {k: 2 * n for k, n in near(once).items()}
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")  # rows without words are linked with nothing and stay
    assert minhash.near_dedup(twice).where(worded).count() == minhash.near_dedup(once).where(worded).count()
    mixed = mixing.mix(twice, with_source=True).collect()
    taken = collections.Counter()
    for r in mixed:
        taken[r.source] += r.taken
    assert len(mixed) == 2 * once.count() and all(abs(taken[r.source] - r.target) <= 0.5 and r.taken <= 2 * r["size"] for r in mixed)
    for r in repeats.repeats_digest(twice).collect():  # a copy repeats whatever has 400 bytes
        assert r.n_removed == (r.n_bytes if r.n_bytes >= 400 else 0)
    kept = exact_dedup.exact_groups(twice)
    assert kept.count() == 2 * once.count() and kept.where("kept").count() == exact_dedup.exact_groups(once).where("kept").count()


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """One row of each group stays, also if its id comes again with another text."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    other = " ".join(f"w{k}" for k in range(20))
    rows = [(1, base), (2, base.upper()), (2, other), (3, other), (3, other), (3, None), (None, base), (4, "")]
    out = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter([(1, base), (2, other), (3, None), (None, base), (4, "")])


def test_null_ids(spark, docs, labels):
    df = docs.selectExpr("cast(null as long) as doc_id", "text", "source")
    n = df.count()
    for run in (brown.brown_scores, bpe.bpe_digest, mixing.mix, minhash.near_duplicates, exact_dedup.exact_groups, token_store.store_digest, quality.quality_report, repeats.repeats_digest, lambda d: toxicity.toxicity(d, labels)):
        got = run(df)
        assert got.count() == n and got.where("doc_id is not null").count() == 0
    for stage in (quality.quality_filter, exact_dedup.exact_dedup, minhash.near_dedup, mixing.mix_documents):
        assert stage(df).columns == df.columns
    every = spark.createDataFrame([(None, None, None, None)] * 3, "conv_id long, turn long, role string, text string")
    assert chat.format_chat(every).count() == 3


def test_very_long_texts(spark, labels):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(5000)]
    long_ = " ".join(r.choice(vocab) for _ in range(330_000))  # 2 MB
    rows = [(1, long_, "s"), (2, long_[: len(long_) // 2], "s"), (3, "a" * 300_000, "s"), (4, "ab" * 60_000, "t"), (5, long_[1000:1500], "t")]
    df = common.shared_table(spark.createDataFrame(rows, "doc_id long, text string, source string"), "long")
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for i, t, _ in rows}
    assert {x.doc_id: x.ids_sha256 for x in bpe.bpe_digest(df).collect()} == {i: hashlib.sha256(x.tobytes()).hexdigest() for i, x in want.items()}
    assert {x.doc_id: x.n_tokens for x in token_store.store_digest(df).collect()} == {i: len(x) + 1 for i, x in want.items()}
    assert {x.doc_id: x.n_tokens for x in brown.brown_scores(df).collect()} == {i: len(words(t)) + 1 for i, t, _ in rows}
    assert {x.doc_id: x.n_words for x in quality.quality_report(df).collect()} == {i: len(WORD.findall(t)) for i, t, _ in rows}
    assert {x.doc_id: x.group_size for x in exact_dedup.exact_groups(df).collect()} == dict.fromkeys(want, 1)
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == {i: i for i in want}
    assert mixing.mix(df).count() == toxicity.toxicity(df, labels).count() == 5
    # the half text repeats all of itself in the whole one; in one letter and in two every window comes again
    assert {x.doc_id: x.n_removed for x in repeats.repeats_digest(df).collect()} == {1: len(long_) // 2, 2: len(long_) // 2, 3: 300_000, 4: 120_000, 5: 500}


def test_stages_on_empty_and_blank_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, rows in enumerate(([], [(1, None, None, None, None), (None, None, None, None, None), (2, " ", "x", "y", 1), (2, " ", "x", "y", 1)])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        docs = common.table(spark, folder, "documents")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() <= len(rows)
            if name != "bpe":
                assert out.columns == docs.columns
        assert corpus_pipeline.run(spark, folder).count() == 0


def test_ties_go_by_id(spark):
    rows = [(3, "Same text here"), (1, "same text here"), (2, "same TEXT here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in exact_dedup.exact_dedup(df).collect()] == [1] == [r.doc_id for r in minhash.near_dedup(df).collect()]
    assert {r.keep_id for r in exact_dedup.exact_groups(df, "largest").collect()} == {3}
    assert lower("É A") == "É a" and remainder(3, 5) in range(5)
