"""Token-id shards with keyed access through a minimal perfect hash.

Documents are range-partitioned and sorted by id; each partition writes one shard file:

    payload   token ids, little-endian, 2 bytes each if the vocabulary allows, else 4
    sections  keys in file order (doc_id, valid), hash levels, rank samples, and per slot
              the fingerprint, start and length of the key's ids
    footer    JSON with the sections' places, then its length and the magic bytes

A key is found in constant time: its bit in the first level where it stands alone,
the number of bits before it (its slot), the slot's fingerprint, then start and length
in the payload. A key that was never stored is told by its fingerprint, wrongly once
in 2^32.

Shards are written under a name of the task attempt and listed in a manifest that is
itself a committed table: a task that is run again leaves an unlisted file, never a
torn shard. A task holds one batch of texts and 24 bytes a document, not its payload.

Edge cases: null or blank text gives the end id only; null ids come first; rows that
repeat an id are numbered, the number being part of the key; an empty table gives an
empty manifest.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain, groupby
from struct import pack

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.bpe import checked, read_spec
from netloom.llm.common import give_back, scratch_path, shared_table, shuffle_partitions, slices, spark_schema, text_bytes

MAGIC = b"NLTOKS01"
END_ID = 2
CACHE = 400_000


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_of(ids: np.ndarray, valid: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """A 64-bit key of an id (or null) and its turn among rows that repeat it."""
    with np.errstate(over="ignore"):
        return _mix(np.where(valid, ids, 0).astype("i8").view("u8"), 1) ^ _mix(turn.astype("u8") * np.uint64(2) + (~valid).astype("u8"), 2)


class PerfectHash:
    """Minimal perfect hash by levels of bit arrays; a key's bit is set where it stands alone."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.cumsum([0, *sizes])

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 2.0) -> PerfectHash:
        sizes, bits, rest, level = [], [], keys, 0
        while len(rest):
            m = max(64, -(-int(len(rest) * load) // 64) * 64)
            at = _mix(rest, level + 3) % np.uint64(m)
            alone = np.bincount(at.astype("i8"), minlength=m) == 1
            bits.append(alone)
            sizes.append(m)
            rest = rest[~alone[at.astype("i8")]]
            level += 1
            if level > 200:
                raise ValueError("keys are not distinct")
        flat = np.concatenate(bits) if bits else np.zeros(64, bool)
        words = np.packbits(flat, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype="u8")])[:-1]
        return cls(sizes, words, ranks.astype("<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that were not stored (others are told by fingerprint)."""
        out = np.full(len(keys), -1, "i8")
        left = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = (_mix(keys[left], level + 3) % np.uint64(m)).astype("i8") + self.starts[level]
            word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype("u8")
            hit = (word & bit) != 0
            out[left[hit]] = (self.ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))).astype("i8")
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 99) >> np.uint64(32)).astype("<u4")


def turns(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... among adjacent rows of one id."""
    n = len(ids)
    if not n:
        return np.zeros(0, "u8")
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return (np.arange(n) - first).astype("u8")


def write_shard(uri: str, batches: Iterator[tuple[list[int | None], list[np.ndarray]]], width: int) -> tuple[int, int]:
    """Write one shard from (ids, token arrays) in file order; returns its documents and token ids."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    doc_ids: list[np.ndarray] = []
    valids: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    with fs.open_output_stream(path) as out:
        for ids, rows in batches:
            valid = np.array([x is not None for x in ids], bool)
            doc_ids.append(np.array([0 if x is None else x for x in ids], "i8"))
            valids.append(valid)
            lengths.append(np.array([len(r) for r in rows], "u4"))
            if rows:
                out.write(np.concatenate(rows).astype(f"<u{width}").tobytes())
        ids_, valid = np.concatenate([*doc_ids, np.zeros(0, "i8")]), np.concatenate([*valids, np.zeros(0, bool)])
        length = np.concatenate([*lengths, np.zeros(0, "u4")])
        start = np.concatenate([[0], np.cumsum(length, dtype="u8")])
        keys = key_of(ids_, valid, turns(ids_, valid))
        index = PerfectHash.build(keys)
        slot = index.slots(keys)
        by_slot = np.empty(len(keys), "i8")
        by_slot[slot] = np.arange(len(keys))
        sections = {
            "doc_id": ids_.astype("<i8"), "valid": valid.astype("u1"), "words": index.words.astype("<u8"), "ranks": index.ranks,
            "print": fingerprints(keys)[by_slot], "start": start[:-1][by_slot].astype("<u8"), "length": length[by_slot].astype("<u4"),
        }
        at, places = int(start[-1]) * width, {}
        for name, a in sections.items():
            places[name] = [at, a.nbytes, a.dtype.str]
            out.write(a.tobytes())
            at += a.nbytes
        footer = json.dumps({"width": width, "ids": int(start[-1]), "docs": len(keys), "levels": index.sizes, "sections": places}, sort_keys=True).encode()
        out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
    return len(keys), int(start[-1])


class Shard:
    """Keyed access to a shard; the index is read at opening, ids when asked for."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        n = int.from_bytes(tail[:8], "little")
        self.meta = json.loads(self.file.read_at(n, size - 16 - n))
        self.width = self.meta["width"]
        get = lambda name: np.frombuffer(self.file.read_at(self.meta["sections"][name][1], self.meta["sections"][name][0]), self.meta["sections"][name][2])
        self.doc_id, self.valid = get("doc_id"), get("valid").astype(bool)
        self.index = PerfectHash(self.meta["levels"], get("words"), get("ranks"))
        self.prints, self.start, self.length = get("print"), get("start"), get("length")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, start, length) of keys, in constant time each."""
        slot = self.index.slots(keys)
        there = slot >= 0
        safe = np.where(there, slot, 0)
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), "u8"), np.zeros(len(keys), "u4")
        return there & (self.prints[safe] == fingerprints(keys)), self.start[safe], self.length[safe]

    def ids(self, start: int, length: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(int(length) * self.width, int(start) * self.width), f"<u{self.width}")

    def runs(self, start: np.ndarray, length: np.ndarray, most: int = 8 << 20) -> Iterator[np.ndarray]:
        """The ids of documents that follow each other in the file, read many at a time: about ``most`` bytes."""
        end = np.cumsum(length.astype("i8"))
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most // self.width, "right")))
            ids = self.ids(start[at], int(end[to - 1] - (end[at - 1] if at else 0)))
            yield from np.split(ids, (end[at : to - 1] - (end[at - 1] if at else 0)))
            at = to

    def get(self, doc_id: int | None, turn: int = 0) -> np.ndarray | None:
        """The ids of a document, or None if the shard does not hold it."""
        found, start, length = self.find(key_of(np.array([doc_id or 0]), np.array([doc_id is not None]), np.array([turn])))
        return self.ids(start[0], length[0]) if found[0] else None


_ENCODERS: dict[str, object] = {}


class LibraryEncoder:
    """The tokenizers library, asked once for each word that a worker meets (two generations of CACHE words)."""

    def __init__(self, spec: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, spec: bytes) -> LibraryEncoder:
        key = hashlib.sha256(spec).hexdigest()
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(spec)
        return _ENCODERS[key]

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian 32-bit numbers.

        No token spans white space, the vocabulary lower-cases what is no special token
        (they start with ``<|``), and a full stop or comma after a letter is a piece of
        its own; so words are asked for in lower case and without that last mark.
        """
        words = (text if b"<|" in text else text.lower()).split()
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        unknown, marked = set(), []
        for w in set(words):
            if w in new:
                continue
            if w in old:
                new[w] = old[w]
                continue
            if len(w) > 1 and w[-1] in b".," and 97 <= w[-2] <= 122:
                marked.append(w)
                parts = (w[:-1], w[-1:])
            else:
                parts = (w,)
            for x in parts:
                if x not in new:
                    if x in old:
                        new[x] = old[x]
                    else:
                        unknown.add(x)
        asked = list(unknown)
        for k in range(0, len(asked), 4096):
            part = asked[k : k + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                new[w] = pack(f"<{len(e.ids)}I", *e.ids)
        for w in marked:
            new[w] = new[w[:-1]] + new[w[-1:]]
        return b"".join([new[w] for w in words])


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` in ascending id order to shards in ``folder``; returns the manifest.

    Manifest: part, uri, n_docs, n_ids, low and high (its smallest and largest id, null if
    it has none), first_id (ids in all shards before it).
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(path))
    data = checked(spec.value)
    width = 2 if max(*data["model"]["vocab"].values(), end_id, *[t["id"] for t in data["added_tokens"]]) < 1 << 16 else 4
    columns = "part long, uri string, n_docs long, n_ids long, low long, high long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        context, encoder = TaskContext.get(), LibraryEncoder.of(spec.value)
        uri = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.tok"
        end, ends = np.array([end_id], "<u4").tobytes(), []

        def rows():
            for batch in chain([first], batches):
                for b in slices(batch):
                    yield convert(b)

        def convert(b: pa.RecordBatch):
            known = b.column(0).drop_null()
            if len(known):
                ends.extend([known[0].as_py(), known[-1].as_py()])  # rows come in order of their ids
            return b.column(0).to_pylist(), [np.frombuffer(encoder.encode(t) + end, "<u4") for t in text_bytes(b.column(1))]

        n_docs, n_ids = write_shard(uri, rows(), width)
        row = (context.partitionId(), uri, n_docs, n_ids, min(ends, default=None), max(ends, default=None))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if k == 1 else pa.int64()) for k, x in enumerate(row)], [c.split()[0] for c in columns.split(", ")])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = shards or shuffle_partitions(spark)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = shared_table(ordered.mapInArrow(write, spark_schema(columns)), "manifest")
    # a row per shard
    return manifest.withColumn("first_id", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))


def read_store(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each fetched through the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row["uri"])
                found, start, length = shard.find(key_of(shard.doc_id, shard.valid, turns(shard.doc_id, shard.valid)))
                if not found.all():
                    raise ValueError(f"{row['uri']}: a key of the shard is not in its index")
                if (start[1:] != start[:-1] + length[:-1]).any():
                    raise ValueError(f"{row['uri']}: documents do not follow each other")
                sums = np.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.runs(start, length)], "i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_id, pa.int64(), mask=~shard.valid), pa.array(start.astype("i8") + row["first_id"]), pa.array(length.astype("i8")), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    spread = manifest.select("uri", "first_id").repartition(shuffle_partitions(manifest.sparkSession), "uri")
    return spread.mapInArrow(read, spark_schema("doc_id long, start long, n_tokens long, ids_crc32 long"))


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted ids; each shard answers for the ids inside its range.

    The manifest's bounds (a row per shard) are broadcast; each wanted id finds its shard
    by bisection, and only shards that hold wanted ids are opened.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for uri, group in groupby(pairs, key=lambda x: x[0]):
                shard, found = Shard(uri), []
                for _, doc_id in group:
                    ids = shard.get(doc_id)
                    if ids is not None:
                        found.append((doc_id, ids.astype("i4")))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    spark = manifest.sparkSession
    found = sorted((r["low"], r["high"], r["uri"]) for r in manifest.where("low is not null").select("low", "high", "uri").collect())  # a row per shard
    shared = spark.sparkContext.broadcast(found)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        low = np.array([x[0] for x in ranges], "i8")
        for b in batches:
            ids = b.column(0).to_numpy()
            at = np.searchsorted(low, ids, "right") - 1
            keep = [k for k, i in enumerate(at.tolist()) if i >= 0 and ids[k] <= ranges[i][1]]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([ranges[at[k]][2] for k in keep]), pa.array(ids[keep])], ["uri", "doc_id"])

    keys = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    placed = keys.mapInArrow(place, spark_schema("uri string, doc_id long"))
    return placed.repartition(shuffle_partitions(spark), "uri").mapInArrow(fetch, spark_schema("doc_id long, ids array<int>"))


def store_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and read every document back by key."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_store(write_store(docs, folder, path))
