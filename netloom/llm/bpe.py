"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each leaf of the tree holds the rank of the pair that starts at one symbol, joined
with the position, so the root is the leftmost pair of the lowest rank. A merge
changes three leaves; each change is a walk to the root. Encoding n symbols thus takes
O(n log n), also for one word of a megabyte. Pieces of up to ``SHORT`` symbols have their
trees side by side in one array, ``BLOCK`` at a time: a round takes each root, merges
there and walks up in all of them.

The rest follows the vocabulary file: special tokens are cut out first, then NFC,
lower case, a split into pieces, and bytes as printable characters with ``</w>`` at a
piece's end. A file that asks for anything else is refused. As no piece spans white
space, words are encoded one by one; a task remembers the words and pieces it has met,
in about ``CACHE`` bytes (what is forgotten is encoded again).

Edge cases: null or blank texts have no tokens and decode to the empty text; repeated
rows are encoded alike; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import map_arrow, text_bytes

CACHE = 96 << 20
SHORT, BLOCK = 63, 4096
#: Words looked up in one go.
_WORDS = 1 << 15
_NONE = 1 << 62
#: Where a row of symbols has none; no vocabulary has this id.
_GAP = (1 << 24) - 1
#: Fixed by the vocabulary file: how it normalises and splits a text, and that ids are decoded to their tokens with spaces between.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The split, with white space as the library has it.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+|\n")  # a line is a word


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def _parts(rows: list, most: int) -> Iterator[list]:
    return (rows[at : at + most] for at in range(0, len(rows), most))


class PairTree:
    """Minimum over leaves, with point updates."""

    __slots__ = ("size", "node")

    def __init__(self, keys: list[int]):
        self.size = size = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = node = [_NONE] * size + keys + [_NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def put(self, leaf: int, key: int) -> None:
        node, i = self.node, leaf + self.size
        node[i] = key
        while i > 1:
            other = node[i ^ 1]
            i >>= 1
            low = key if key < other else other
            if node[i] == low:
                return
            node[i] = key = low


def checked(spec: str | bytes) -> dict:
    """The vocabulary file's contents, if it works as this module does; else an error."""
    data = json.loads(spec)
    model = data["model"]
    wanted = {
        "normalizer": (data.get("normalizer"), _NORMALIZER),
        "pre_tokenizer": (data.get("pre_tokenizer"), _PRE_TOKENIZER),
        "decoder": (data.get("decoder"), None),
        "model type": (model.get("type"), "BPE"),
        **{k: (model.get(k) or None, None) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")},
        **{f"added token {t['content']}": (t["content"][:2] == "<|" and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]), True) for t in data["added_tokens"]},
    }
    if odd := [k for k, (has, want) in wanted.items() if has != want]:
        raise ValueError(f"this vocabulary file can't be used: {', '.join(odd)} differ from what is built in")
    return data


class Memory:
    """What has been met lately, in about ``most`` bytes: two generations, the older of which is forgotten."""

    __slots__ = ("most", "held", "new", "old")

    def __init__(self, most: int):
        self.most, self.held, self.new, self.old = most // 2, 0, {}, {}

    def look_up(self, keys: set, learn: Callable[[list], list[bytes]]) -> dict:
        """The values of all ``keys``; ``learn`` gives those of keys that aren't remembered."""
        found = dict(zip(keys, map(self.new.get, keys), strict=True))
        late = [k for k, v in found.items() if v is None]
        found.update(zip(late, map(self.old.get, late), strict=True))
        for some in _parts([k for k in late if found[k] is None], _WORDS):
            found.update(zip(some, learn(some), strict=True))
        for some in _parts(late, _WORDS):
            values = [found[k] for k in some]
            self.new.update(zip(some, values, strict=True))
            self.held += sum(map(len, some)) + sum(map(len, values)) + 180 * len(some)  # two objects and their place
            if self.held >= self.most:
                self.old, self.new, self.held = self.new, {}, 0
        return found


class Bpe:
    def __init__(self, spec: str | bytes, cache: int = CACHE):
        data = checked(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: t.encode() for t, i in self.vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        #: pair of ids (left * 2**24 + right) -> rank * 2**32; rank -> merged id
        self.rank: dict[int, int] = {}
        self.merged = array("I")
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(self.vocab[a] << 24 | self.vocab[b], rank << 32)
            self.merged.append(self.vocab[a + b])
        alphabet = byte_alphabet()
        #: symbols of each byte inside a piece, and at its end; None where the vocabulary lacks it
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.last = [self.vocab.get(c + self.end) for c in alphabet]
        del self.vocab
        #: the same for arrays: pairs in order, with one that none equals at the end, and their ranks
        pairs = np.fromiter(self.rank, "i8", len(self.rank))
        order = np.argsort(pairs)
        self._pairs = np.append(pairs[order], _NONE)
        self._ranks = np.append(np.fromiter(self.rank.values(), "i8", len(order))[order] >> 32, 0)
        self._merged = np.array(self.merged, "i8")
        self._inner, self._last = (np.array([_GAP if x is None else x for x in side], "i8") for side in (self.inner, self.last))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known, self.pieces = Memory(cache * 2 // 3), Memory(cache // 3)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges, lowest rank first and leftmost among equals, until none applies."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, merged = self.rank.get, self.merged
        tree = PairTree([r | i if (r := rank(a << 24 | b)) is not None else _NONE for i, (a, b) in enumerate(pairwise(symbols))])
        node, put = tree.node, tree.put
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols = list(symbols)
        while (least := node[1]) < _NONE:
            i = least & 0xFFFFFFFF
            j = after[i]
            symbols[i] = s = merged[least >> 32]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                put(j, _NONE)
                put(i, r | i if (r := rank(s << 24 | symbols[k])) is not None else _NONE)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                put(h, r | h if (r := rank(symbols[h] << 24 | s)) is not None else _NONE)
        return [s for s in symbols if s >= 0]

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the leaves at ``at`` hold for these pairs."""
        pair = left << 24 | right
        place = np.searchsorted(self._pairs, pair)
        return np.where(self._pairs[place] == pair, self._ranks[place] * (SHORT + 1) | at, _NONE)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids of pieces of fewer than ``width`` bytes, a power of two: ``merge`` on a tree of ``width`` leaves for each.

        Symbols stand from place 1 on, so that there is a gap before and behind them.
        """
        m, depth, places = len(pieces), width.bit_length() - 1, width + 1
        sizes = np.fromiter(map(len, pieces), "i8", m)
        raw, ends = np.frombuffer(b"".join(pieces), "u1"), np.cumsum(sizes)
        flat = self._inner[raw]
        flat[ends - 1] = self._last[raw[ends - 1]]
        row = np.repeat(np.arange(m), sizes)
        if (lacking := flat == _GAP).any():
            flat, row = flat[~lacking], row[~lacking]
            sizes = np.bincount(row, minlength=m)
            ends = np.cumsum(sizes)
        place = np.arange(1, len(flat) + 1) - np.repeat(ends - sizes, sizes)
        symbol = np.full(m * places, _GAP, "i8")
        symbol[row * places + place] = flat
        after, before = np.tile(np.arange(1, places + 1), m), np.tile(np.arange(-1, places - 1), m)
        tree = np.full((m, 2 * width), _NONE, "i8")
        tree[row, width + place] = self._keys(flat, symbol[row * places + place + 1], place)
        low = width
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        node, live = tree.reshape(-1), np.arange(m)
        while True:
            least = node[live * (2 * width) + 1]
            on = least < _NONE
            live, least = live[on], least[on]
            if not len(live):
                break
            start = live * places
            i, new = least & SHORT, self._merged[least // (SHORT + 1)]
            j = after[start + i]
            k, h = after[start + j], before[start + i]
            symbol[start + i], symbol[start + j] = new, _GAP
            after[start + i], before[start + k] = k, i
            keys = self._keys(np.concatenate([new, symbol[start + h]]), np.concatenate([symbol[start + k], new]), np.concatenate([i, h]))
            at, root = np.concatenate([i, h, j]) + width, np.tile(live * (2 * width), 3)
            node[root + at] = np.concatenate([keys, np.full(len(live), _NONE)])
            for _ in range(depth):
                at >>= 1
                child = root + 2 * at
                node[root + at] = np.minimum(node[child], node[child + 1])
        left = (symbol != _GAP).reshape(m, places)
        ids = symbol[left.reshape(-1)].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(left.sum(1))).tolist()]
        return [ids[a:b] for a, b in pairwise(cuts)]

    def pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces as little-endian 32-bit numbers."""
        raws = [p.encode() for p in pieces]
        sizes, out = np.fromiter(map(len, raws), "i8", len(raws)), [b""] * len(raws)
        width = 2
        while width <= SHORT + 1:
            for some in _parts(np.flatnonzero((sizes < width) & (2 * sizes >= width)).tolist(), BLOCK):
                for n, ids in zip(some, self._merge_rows([raws[n] for n in some], width), strict=True):
                    out[n] = ids
            width *= 2
        for n in np.flatnonzero(sizes > SHORT).tolist():
            symbols = [self.inner[b] for b in raws[n]]
            symbols[-1] = self.last[raws[n][-1]]
            ids = self.merge([s for s in symbols if s is not None])
            out[n] = pack(f"<{len(ids)}I", *ids)
        return out

    def words_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of words as little-endian 32-bit numbers; no piece spans two lines, so all are cut at once."""
        text, found = b"\n".join(words).decode(), []
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                found.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            found += _PIECES.findall(part.replace("Σ", "σ").lower())
        ids = self.pieces.look_up({*found} - {"\n", *self.special.values()}, self.pieces_ids) | {i: pack("<I", i) for i in self.special.values()}
        out, word = [], []
        for p in found:
            if p == "\n":
                out.append(b"".join(word))
                word = []
            else:
                word.append(ids[p])
        return [*out, b"".join(word)]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers.

        The vocabulary lower-cases all but special tokens, which start with ``<|``.
        """
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        ids = self.known.look_up(set().union(*words), self.words_ids)
        return [b"".join(map(ids.__getitem__, ws)) for ws in words]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The tokens of ids that the vocabulary has, with spaces between."""
        token = self.token
        try:
            return b" ".join([token[i] for i in ids])
        except KeyError:
            return b" ".join([token[i] for i in ids if i in token])


def read_spec(path: str | None = None) -> bytes:
    """The vocabulary file's bytes (a few MB, fixed), read on the driver and broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def _with_bpe(rows: DataFrame, path: str | None, cache: int, fn: Callable[[pa.RecordBatch, Bpe], pa.RecordBatch], ddl: str) -> DataFrame:
    """``map_arrow`` with an encoder for each task, which is forgotten when the task ends."""
    spec = rows.sparkSession.sparkContext.broadcast(read_spec(path))
    return map_arrow(rows, fn, ddl, lambda: Bpe(spec.value, cache))


def _rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """(doc_id, ids array<int>) for every row."""

    def batch(b: pa.RecordBatch, bpe: Bpe) -> pa.RecordBatch:
        rows = [np.frombuffer(raw, "<u4") for raw in bpe.encode_all(text_bytes(b.column(1)))]
        ends = np.cumsum([0, *map(len, rows)])
        values = np.concatenate(rows).astype("i4") if rows else np.empty(0, "i4")
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))], ["doc_id", "ids"])

    return _with_bpe(_rows(docs, id_col, text_col), path, cache, batch, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to the empty text."""

    def batch(b: pa.RecordBatch, bpe: Bpe) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()).decode() for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return _with_bpe(encoded.select("doc_id", "ids"), path, 0, batch, "doc_id long, text string")


def bpe_digest(docs: DataFrame, path: str | None = None, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded again, in one pass.

    ``cache`` bounds the bytes that a task remembers; it changes memory and time, never
    results.
    """

    def batch(b: pa.RecordBatch, bpe: Bpe) -> pa.RecordBatch:
        n, ids, back = [], [], []
        for raw in bpe.encode_all(text_bytes(b.column(1))):
            n.append(len(raw) // 4)
            ids.append(hashlib.sha256(raw).hexdigest())
            back.append(hashlib.sha256(bpe.decode(np.frombuffer(raw, "<u4").tolist())).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _with_bpe(_rows(docs), path, cache, batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
