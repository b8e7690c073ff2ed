"""Near-duplicates by one-permutation MinHash, checked on full shingle sets.

1. One pass over the texts: 64-bit shingle hashes, the set's 128-bit key, and a
   signature of 256 bins of one permutation. An empty bin takes the value of the first
   filled bin in an order of its own (optimal densification). Five bins make a band.
2. Texts with one set are one node; copies cost nothing from here on.
3. Nodes of a bucket are joined to its smallest node only (a star), so a bucket of n
   nodes gives n - 1 edges. The edges' components, clusters, hold every pair that
   shares a bucket. At a similarity of 0.75 a pair shares none of the 48 bands with a
   chance of 2e-6.
4. Inside a cluster similarities are exact. A cluster is cut in blocks of ``BLOCK``
   nodes and each two blocks meet in one task, which counts common shingles for all
   its pairs in a matrix and returns only a spanning forest of the links it finds. No
   pair list is ever written, no partner is left out, and memory is bounded by the
   block, not by the cluster.
5. The links' components give each document the smallest id that it reaches.

Edge cases: texts without words (null, empty, white space) have an empty set and are
linked with nothing; fewer than five words are one shingle; a null id is no smallest
id; rows that repeat an id are nodes by their texts; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import map_arrow, packed, shared_table, shuffle_partitions, skew_join, spark_schema, text_bytes, unpacked
from netloom.llm.components import components

BINS, ROWS, BANDS = 256, 5, 48
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000  # of nodes and of their shingles, about
WORDS = 5
_ORDER = np.argsort(np.random.default_rng(20).random((BINS, BINS)), axis=1).argsort(axis=1).astype("u1")  # rank of each bin for each empty bin
_ODD = (np.random.default_rng(21).integers(1, 1 << 62, ROWS, dtype="u8") << np.uint64(1)) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: dict, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(hashes.__getitem__, words), "u8", len(words))
    with np.errstate(over="ignore"):
        n = max(1, len(words) - k + 1)
        out = np.full(n, min(len(words), k), "u8")
        for j in range(min(k, len(words))):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted, non-empty set: BINS minima, empty bins densified."""
    of = (s >> np.uint64(56)).astype("i8")
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    sig, filled = np.zeros(BINS, "u8"), of[first]
    sig[filled] = s[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        sig[empty] = sig[filled[_ORDER[np.ix_(empty, filled)].argmin(1)]]
    return sig


def bands(s: np.ndarray) -> np.ndarray:
    """BANDS bucket keys of a non-empty set; the band's number is part of the key."""
    with np.errstate(over="ignore"):
        rows = signature(s)[: ROWS * BANDS].reshape(BANDS, ROWS)
        return mix((mix(rows) * _ODD).sum(1, dtype="u8") + np.arange(1, BANDS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)).view("i8")


def set_key(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes(), usedforsecurity=False).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k, bands): k is the set's key, null for an empty set."""

    def batch(b: pa.RecordBatch, hashes: _Hashes) -> pa.RecordBatch:
        n, keys, rows = [], [], []
        for t in text_bytes(b.column(1)):
            s = shingles(t, hashes)
            n.append(len(s))
            keys.append(set_key(s) if len(s) else None)
            rows.append(bands(s) if len(s) else np.zeros(0, "i8"))
        ends = np.cumsum([0, *map(len, rows)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, "i8")])))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n", "k", "bands"])

    return map_arrow(_rows(docs), batch, "doc_id long, n long, k binary, bands array<long>", _Hashes)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def star_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): each node of a bucket with the bucket's smallest node. nodes: (k, bands)."""
    rows = nodes.select("k", F.explode("bands").alias("bucket"))
    stars = shared_table(rows.groupBy("bucket").agg(F.min("k").alias("star"), F.count("*").alias("size")).where("size > 1"), "stars")
    return skew_join(rows, stars, "bucket", "size").where("k <> star").select(F.col("k").alias("a"), F.col("star").alias("b")).distinct()


def links_between(sizes: np.ndarray, tokens: np.ndarray, owners: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` members.

    Members are 0..m-1 with ``sizes``; (tokens, owners) lists every member's shingles.
    Frequent shingles are counted by a matrix product, others pair by pair.
    """
    m = len(sizes)
    order = np.argsort(tokens, kind="stable")
    t, o = tokens[order], owners[order]
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, "i8")
    df = np.diff(np.append(start, len(t)))
    common = np.zeros((m, m), "f4")
    hot = df >= 48
    for at in range(0, int(hot.sum()), 4096):  # a bounded number of columns at a time
        s, d = start[hot][at : at + 4096], df[hot][at : at + 4096]
        grid = np.zeros((m, len(s)), "f4")
        column = np.repeat(np.arange(len(s)), d)
        place = np.repeat(s, d) + (np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d))
        grid[o[place], column] = 1
        common += grid @ grid.T
    flat = common.reshape(-1)
    for size in np.unique(df[~hot]):
        if size < 2:
            continue
        s = start[~hot][df[~hot] == size]
        for at in range(0, len(s), max(1, 2_000_000 // int(size * size))):
            own = o[s[at : at + max(1, 2_000_000 // int(size * size))][:, None] + np.arange(size)]
            pair = (own[:, :, None].astype("i8") * m + own[:, None, :]).reshape(-1)
            where, n = np.unique(pair, return_counts=True)
            flat[where] += n
    inter = common[np.ix_(left, right)]
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    x, y = np.nonzero((100 * inter >= percent * union) & (left[:, None] != right[None, :]))
    parent = list(range(m))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(left[x].tolist(), right[y].tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            parent[p] = q
            out.append((i, j))
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one ``task`` each, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        task = b.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column("task")[-1].as_py() != task[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def exact_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that connect what is linked in each cluster. members: (cluster, k, n, shingles binary)."""
    spark = members.sparkSession
    sizes = shared_table(members.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles_in")), "sizes")
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(BLOCK), F.col("shingles_in") / F.lit(BLOCK_SHINGLES))).cast("int")
    placed = skew_join(members, sizes, "cluster", "members").withColumn("blocks", F.least(F.col("members"), blocks).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("k", F.lit(7)), F.col("blocks")).cast("int"))
    # a node meets each block of its cluster once, in the task of the two blocks
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.select(F.xxhash64("cluster", low, high).alias("task"), "cluster", low.alias("low"), high.alias("high"), "own", "k", "n", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            k, n = t["k"].to_pylist(), t["n"].to_numpy()
            lists = [np.frombuffer(x, "u8") for x in t["shingles"].to_pylist()]
            own, low = t["own"].to_numpy(), t["low"].to_numpy()
            block_of = list(zip(t["cluster"].to_pylist(), low.tolist(), t["high"].to_pylist(), strict=True))
            found = []
            for block in sorted(set(block_of)):  # more than one only where task numbers, hashes, happen to agree
                at = np.array([i for i, b in enumerate(block_of) if b == block])
                tokens = np.concatenate([lists[i] for i in at])
                owners = np.repeat(np.arange(len(at)), n[at])
                side = own[at] == block[1]
                left, right = np.flatnonzero(side), np.flatnonzero(~side) if block[1] != block[2] else np.flatnonzero(side)
                found += [(k[at[i]], k[at[j]]) for i, j in links_between(n[at], tokens, owners, left, right, percent)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["a", "b"])

    return met.repartition(shuffle_partitions(spark), "task").sortWithinPartitions("task").mapInArrow(run, spark_schema("a binary, b binary"))


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, k, root, component_id) for every row; root tells its component, null for an empty set."""
    rows = shared_table(sketches(docs), "sketches")
    # rows of one set have one size and one list of bands
    nodes = rows.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = shared_table(nodes, "nodes")
    clusters = shared_table(components(star_edges(nodes.select("k", "bands"))).withColumnRenamed("node", "k").withColumnRenamed("root", "cluster"), "clusters")

    def sets(b: pa.RecordBatch, hashes: _Hashes) -> pa.RecordBatch:
        found = [shingles(t, hashes) for t in text_bytes(b.column(1))]
        return pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["k", "n", "shingles"])

    wanted = clusters.join(nodes, "k").select("k", "cluster", "label")
    ids = wanted.select(F.col("label").alias("wanted_id")).distinct()
    some = _rows(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    full = map_arrow(some, sets, "k binary, n long, shingles binary", _Hashes).dropDuplicates(["k"])
    members = shared_table(full.join(wanted.select("k", "cluster"), "k"), "members")
    found = shared_table(components(exact_links(members, percent)), "found")
    best = shared_table(found.join(nodes, found.node == nodes.k).groupBy("root").agg(F.min("label").alias("component_id"), F.count("*").alias("size")), "best")
    of = skew_join(found, best, "root", "size").select(F.col("node").alias("k"), "root", "component_id")
    by_node = shared_table(nodes.join(of, "k", "left").select("k", "copies", F.coalesce("root", "k").alias("root"), F.coalesce("component_id", "label").alias("component_id")), "labels")
    some = skew_join(rows.where("k is not null").select("doc_id", "n", "k"), by_node, "k", "copies").select("doc_id", "n", "k", "root", "component_id")
    none = rows.where("k is null").select("doc_id", "n", "k", F.col("k").alias("root"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; linked if 100 * common >= percent * union."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return _labelled(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def near_dedup(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group of near-duplicates, with its columns; rows with a null id stay.

    The row with the group's smallest id stays. Where rows repeat an id, each is judged
    by its own text: those with another group's text stay or go with that group, and of
    several of one group one stays. Rows without words are linked with nothing and stay.
    """
    of = shared_table(_labelled(docs, percent).select("doc_id", "k", "root", "component_id"), "labelled").where("doc_id is not null")
    gone = of.where("k is not null and doc_id <> component_id")
    repeated = shared_table(of.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id"), "repeated")
    rows, row = packed(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    if repeated.isEmpty():
        return unpacked(rows.join(gone.select("doc_id").distinct(), "doc_id", "left_anti"), row, docs.columns)
    once = rows.join(repeated, "doc_id", "left_anti").join(gone.select("doc_id"), "doc_id", "left_anti").select(row)

    # rows of a repeated id: their own sets tell which of them go
    def keys(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, _Hashes()) for t in text_bytes(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([set_key(s) if len(s) else None for s in found], pa.binary())], ["at", "k"])

    twice = shared_table(rows.join(repeated, "doc_id", "left_semi").withColumn("at", F.monotonically_increasing_id()), "twice")
    own = twice.select("at", "doc_id").join(map_arrow(twice.select("at", "text"), keys, "at long, k binary"), "at")
    judged = own.join(of.where("k is not null").select("doc_id", "k", "root", "component_id").distinct(), ["doc_id", "k"]).where("doc_id = component_id")
    stay = judged.groupBy("doc_id", "root").agg(F.min("at").alias("at")).select("at").unionByName(own.where("k is null").select("at"))
    return unpacked(once.unionByName(twice.join(stay, "at", "left_semi").select(row)), row, docs.columns)
