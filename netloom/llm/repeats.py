"""Removing repeated byte strings with suffix arrays of shards.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, in
any document or the same one; matches never cross documents.

Finding candidates. Each window of LENGTH bytes has a minimizer, the smallest hash of
its 64-byte strings, which depends on the window's bytes only. Adjacent windows with
one minimizer form a run. Equal windows have equal minimizers, so a run whose minimizer
comes once in the corpus holds no repeat and is dropped; nothing else is.

Judging. Runs of one minimizer go to one shard with their bytes, runs of equal bytes
once, with their count. A shard's suffix array is sorted by induction and its permuted
common prefixes tell which neighbours share LENGTH bytes. A minimizer of very many
different runs is cut in blocks of about ``BLOCK`` runs and ``BLOCK_BYTES``, each two of
which meet in a shard, so no shard grows with the corpus and no run is left out. Runs are
equal if their lengths, minimizers and 128-bit hashes are.

Passages. LENGTH bytes are some 60 words or more, so a shorter passage stays. Beside the
removal, documents are marked that share a passage with another: by winnowing, a mark is
sure where ``PASSAGE`` words in a row come in two documents, and stands nowhere that fewer
than ``NOISE`` do (A-Z lower-cased, one kind of white space).

Edge cases: null texts are empty; texts shorter than LENGTH lose nothing; a row is
told by its id and a 64-bit hash of its text, so rows that repeat both are copies of
each other; null ids are treated likewise; an empty table gives an empty table.
Removing bytes may cut a UTF-8 character; the kept bytes are returned as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import drop_table, give_back, map_arrow, shared_table, shuffle_partitions, skew_join, spark_schema, text_bytes
from netloom.llm.suffixes import common_prefixes, suffix_array

LENGTH = 400
GRAM = 64
BLOCK, BLOCK_BYTES = 2048, 8_000_000
PASSAGE, NOISE = 50, 30
SHARD_BYTES = 2_000_000
_STEP = 1 << 20
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_ONES = 0xFFFFFFFFFFFFFFFF
_TOP = np.uint64(_ONES)


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each string of GRAM bytes, by doubling."""
    h, k = data.astype("u8") + np.uint64(1), 1
    with np.errstate(over="ignore"):
        for m in _MULTIPLIERS:
            h = h[:-k] * m + h[k:]
            h ^= h >> np.uint64(29)
            k *= 2
    return h


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    padded = np.concatenate([h, np.full(-n % w, _TOP)]).reshape(-1, w)
    before = np.minimum.accumulate(padded, 1).reshape(-1)[:n]
    after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].reshape(-1)[:n]
    return np.minimum(after[: n - w + 1], before[w - 1 :])


def runs_of(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(minimizer, times it stands in the run's bytes, first window, last window)."""
    total, w = len(text) - length + 1, length - GRAM + 1
    data = np.frombuffer(text, "u1")
    for at in range(0, max(total, 0), _STEP):
        n = min(_STEP, total - at)
        h = gram_hashes(data[at : at + n + length - 1])
        m = window_minima(h, w)
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        last = np.append(first[1:], n) - 1
        for lo, hi, value in zip(first.tolist(), last.tolist(), m[first].tolist(), strict=True):
            yield value, int(np.count_nonzero(h[lo : hi + w] == np.uint64(value))), at + lo, at + hi


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def all_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tk, h, c, d, times, lo, hi) of every run; c and d are a 128-bit hash of the run's bytes."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[list[int]] = [[], [], [], [], [], [], []]
        index = []
        for k, t in enumerate(text_bytes(b.column(1))):
            if len(t) < length:
                continue
            tk = text_key(t)
            for value, times, lo, hi in runs_of(t, length):
                index.append(k)
                wide = xxhash.xxh3_128_intdigest(t[lo : hi + length])
                for column, x in zip(out, (tk, value - (1 << 63), (wide >> 64) - (1 << 63), (wide & _ONES) - (1 << 63), times, lo, hi), strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), *[pa.array(x, pa.int64()) for x in out]], ["doc_id", "tk", "h", "c", "d", "times", "lo", "hi"])

    return map_arrow(_rows(docs), batch, "doc_id long, tk long, h long, c long, d long, times long, lo long, hi long")


def repeated_starts(runs: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each run's bytes: whether the string of ``length`` bytes at each start is repeated.

    One suffix array over all runs, parted by zero bytes; a start counts as often as
    its run does.
    """
    sizes = np.array([len(r) + 1 for r in runs])
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(runs) + b"\0", "u1")
    start = np.zeros(len(data), bool)
    weight = np.zeros(len(data), "i8")
    for at, run, n in zip(begin.tolist(), runs, counts, strict=True):
        start[at : at + len(run) - length + 1] = True
        weight[at : at + len(run) - length + 1] = n
    sa = suffix_array(data.astype("i8"), 256)
    shared = common_prefixes(data, sa, length)[sa] >= length
    group = np.cumsum(~shared)
    total = np.bincount(group, weight[sa], minlength=int(group[-1]) + 1 if len(group) else 0)
    repeated = np.zeros(len(data), bool)
    repeated[sa] = start[sa] & (total[group] >= 2)
    return [repeated[at : at + len(run) - length + 1] for at, run in zip(begin.tolist(), runs, strict=True)]


def spans_of(starts: np.ndarray, at: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte spans [from, to) that repeated starts cover; ``at`` is the first start's place."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], starts.astype("i1"), [0]])))
    return [(at + int(a), at + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and held[0]["shard"] != row["shard"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tk, lo, hi): spans [lo, hi) of bytes to remove; spans of a row may overlap."""
    spark = docs.sparkSession
    runs = shared_table(all_runs(docs, length), "runs")
    often = runs.groupBy("h").agg(F.sum("times").alias("n"), F.count("*").alias("rows")).where("n > 1").select("h", "rows")
    often = shared_table(often, "often")
    some = shared_table(skew_join(runs, often, "h", "rows").drop("rows"), "candidates")
    drop_table(runs)
    drop_table(often)
    kind = ["h", "c", "d"]
    kinds = some.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tk", "lo", "hi")).alias("at"))
    kinds = shared_table(kinds.select(*kind, "n", "at.*"), "kinds")
    whole = skew_join(some, kinds.where("n > 1").select(*kind, "n"), kind, "n").select("doc_id", "tk", "lo", (F.col("hi") + length).alias("hi"))

    # runs to judge: those that come once, with one of each other kind of their minimizer
    open_ = kinds.groupBy("h").agg(F.min("n").alias("least"), F.count("*").alias("kinds"), F.sum(F.col("hi") - F.col("lo") + length).alias("bytes")).where("least = 1")
    open_ = shared_table(open_, "open")
    judged = skew_join(kinds, open_.select("h", "kinds", F.col("bytes").alias("bytes_in")), "h", "kinds")
    size = open_.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, int(size // SHARD_BYTES))
    blocks = F.ceil(F.greatest(F.col("kinds") / F.lit(BLOCK), F.col("bytes_in") / F.lit(BLOCK_BYTES)))
    blocks = F.least(F.col("kinds"), blocks).cast("int")
    by_doc = judged.groupBy("doc_id", "tk").agg(F.collect_list(F.struct(*kind, "n", "lo", "hi", blocks.alias("blocks"))).alias("wanted"))
    keyed = map_arrow(_rows(docs), lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text_key(t) for t in text_bytes(b.column(1))], pa.int64())], ["doc_id", "text", "tk"]), "doc_id long, text string, tk long")
    keyed, wanted = keyed.alias("d"), by_doc.alias("w")
    texts = keyed.join(wanted, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.tk") == F.col("w.tk"))).select("d.doc_id", "d.tk", "d.text", "w.wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tk", "h", "c", "d", "n", "lo", "blocks", "data"]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, rows = b.slice(at, 64), []
                for i, tk, text, wanted in zip(*[part.column(k).to_pylist() if k != 2 else text_bytes(part.column(k)) for k in range(4)], strict=True):
                    rows += [(i, tk, x["h"], x["c"], x["d"], x["n"], x["lo"], x["blocks"], text[x["lo"] : x["hi"] + length]) for x in wanted]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 9
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns[:8]], pa.array(columns[8], pa.binary())], names)
        give_back()

    pieces = texts.mapInArrow(cut, spark_schema("doc_id long, tk long, h long, c long, d long, n long, lo long, blocks long, data binary"))
    own = F.pmod(F.xxhash64("c", "d"), F.col("blocks"))
    met = pieces.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("h"), F.lit(shards))).otherwise(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")))
    sharded = met.select(pair.alias("shard"), "doc_id", "tk", *kind, "n", "lo", "data")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches):
            rows = list({(r["h"], r["c"], r["d"]): r for r in rows}.values())  # a copy of a row brings its runs again
            found = []
            for r, starts in zip(rows, repeated_starts([r["data"] for r in rows], [r["n"] for r in rows], length), strict=True):
                if r["n"] == 1:
                    found += [(r["doc_id"], r["tk"], a, b) for a, b in spans_of(starts, r["lo"], length)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "tk", "lo", "hi"])
        give_back()

    parts = max(shuffle_partitions(spark), 1)
    part = sharded.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(judge, spark_schema("doc_id long, tk long, lo long, hi long"))
    spans = shared_table(whole.unionByName(part), "spans")
    for t in (some, kinds, open_):
        drop_table(t)
    return spans


class Winnow:
    """Fingerprints of a text's strings of ``NOISE`` words: the smallest hash of every ``PASSAGE`` words in a row."""

    STEP = 1 << 17  # words at a time, to bound memory

    def __init__(self, passage: int = PASSAGE, noise: int = NOISE):
        self.passage, self.noise = passage, noise
        self.table = bytes.maketrans(b"\t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")
        self.base = 0x9E3779B97F4A7C15
        self.power = self.inverse = np.ones(1, "u8")

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << n.bit_length()
            steps = [np.full(size, x, "u8") for x in (self.base, pow(self.base, -1, 1 << 64))]
            for s in steps:
                s[0] = 1
            with np.errstate(over="ignore"):
                self.power, self.inverse = (np.multiply.accumulate(s) for s in steps)

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text.translate(self.table), "u1")
        gap = np.ones(len(data) + 2, bool)
        np.equal(data, 32, out=gap[1:-1])
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = turn[::2], turn[1::2]
        found = [np.zeros(0, "u8")]
        for at in range(0, max(0, len(start) - self.passage + 1), self.STEP):
            s, e = start[at : at + self.STEP + self.passage - 1], end[at : at + self.STEP + self.passage - 1]
            first, size = int(s[0]), int(e[-1] - s[0])
            self._powers(size + 1)
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(data[first : first + size] * self.power[:size], dtype="u8")])
                s, e = s - first, e - first
                n = len(s) - self.noise + 1
                h = (sums[e[self.noise - 1 :]] - sums[s[:n]]) * self.inverse[s[:n]]
                h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[1]
                h ^= h >> np.uint64(29)
            m = window_minima(h, self.passage - self.noise + 1)
            found.append(m[np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))])
        return np.unique(np.concatenate(found))


def shared_passages(docs: DataFrame, passage: int = PASSAGE, noise: int = NOISE) -> DataFrame:
    """(doc_id, tk) of documents that share a passage with another row; see the module's text."""

    def batch(b: pa.RecordBatch, winnow: Winnow) -> pa.RecordBatch | None:
        texts = text_bytes(b.column(1))
        marks = [winnow.of(t) for t in texts]
        at = np.repeat(np.arange(len(texts)), [len(m) for m in marks])
        keys = np.array([text_key(t) for t in texts], "i8")
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(keys[at]), pa.array(np.concatenate([*marks, np.zeros(0, "u8")]).view("i8"))], ["doc_id", "tk", "mark"])

    marks = map_arrow(_rows(docs), batch, "doc_id long, tk long, mark long", lambda: Winnow(passage, noise))
    marks = shared_table(marks, "marks")
    often = shared_table(marks.groupBy("mark").agg(F.count("*").alias("rows")).where("rows > 1"), "often")
    found = shared_table(skew_join(marks, often, "mark", "rows").select("doc_id", "tk").distinct(), "shared")
    drop_table(marks)
    drop_table(often)
    return found


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed spans, and the bytes that stay."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = b
    return [(a, b) for a, b in merged], b"".join([*kept, text[at:]])


def _with_spans(docs: DataFrame, length: int, passages: bool = False) -> DataFrame:
    """(doc_id, text, spans, shares): shares is true for rows that share a passage, if asked for."""
    shared = shared_passages(docs) if passages else None  # before the spans, so that its tables are gone when theirs come
    found = repeated_spans(docs, length).distinct().withColumn("shares", F.lit(False))
    if shared is not None:
        found = found.unionByName(shared.withColumn("shares", F.lit(True)), allowMissingColumns=True)
    spans = F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")))
    spans = found.groupBy("doc_id", "tk").agg(spans.alias("spans"), F.max("shares").alias("shares")).alias("s")
    keyed = map_arrow(_rows(docs), lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text_key(t) for t in text_bytes(b.column(1))], pa.int64())], ["doc_id", "text", "tk"]), "doc_id long, text string, tk long").alias("d")
    return keyed.join(spans, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.tk") == F.col("s.tk")), "left").select("d.doc_id", "d.text", "s.spans", F.coalesce("s.shares", F.lit(False)).alias("shares"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept binary, spans array<struct<lo, hi>>) for every row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        done = [without(t, [(x["lo"], x["hi"]) for x in s or ()]) for t, s in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True)]
        spans = pa.array([[{"lo": a, "hi": z} for a, z in d[0]] for d in done], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([d[1] for d in done], pa.binary()), spans], ["doc_id", "kept", "spans"])

    return map_arrow(_with_spans(docs, length), batch, "doc_id long, kept binary, spans array<struct<lo: long, hi: long>>")


def repeats_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage for every row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(b.column(1))
        done = [without(t, [(x["lo"], x["hi"]) for x in s or ()]) for t, s in zip(texts, b.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(d[1]) for t, d in zip(texts, done, strict=True)], pa.int64()), pa.array([len(d[0]) for d in done], pa.int64()), pa.array([hashlib.sha256(d[1]).hexdigest() for d in done], pa.string()), b.column(3)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"],
        )

    return map_arrow(_with_spans(docs, length, passages=True), batch, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean")
