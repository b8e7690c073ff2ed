"""Harmonic closeness over all that a vertex reaches, without writing a pair.

All pairs of a component are too many to write: 90,000 vertices have 8.1e9. A task takes a
block of sources, each a bit of a row of words, and spreads the bits of all of them through
the links at once, a level at a time; a level's new bits are counted by source. What a task
holds are the links and four bit tables of a block over its components' vertices, about
``STATE`` bytes together. The links reach the tasks by broadcast, in 4 bytes each way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STATE = 64_000_000  # bytes of a block's bit tables, unless one word a vertex takes more
WORDS = 64  # of 64 sources each, in a block at most
PACK = 4096  # vertices, about, of small components that share a block
PIECE = 2_000_000  # words gathered at a time
WORD = np.dtype("<u8")


def harmonic(links: DataFrame) -> DataFrame:
    """(id, closeness) of every vertex with a link. ``links`` are simple and go both ways."""
    spark = links.sparkSession
    pairs = links.where("src < dst").select("src", "dst").toArrow()
    ids, indptr, cols, starts = _ordered(pairs["src"].to_numpy(), pairs["dst"].to_numpy())
    blocks = _blocks(starts, len(ids))
    shared, tasks = spark.sparkContext.broadcast((ids, indptr, cols, blocks)), max(1, min(len(blocks), 32 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, indptr, cols, blocks = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, high = blocks[k][2:]
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high]), pa.array(_sums(indptr, cols, *blocks[k]))], ["id", "closeness"])

    return spark.range(0, len(blocks), 1, tasks).mapInArrow(run, "id long, closeness double")


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vertices by component; their links, as offsets and places of the other ends; where components start."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    component = _components(a, b, len(ids))
    order = np.argsort(component, kind="stable")
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    src, dst = np.concatenate([place[a], place[b]]), np.concatenate([place[b], place[a]])
    by = np.argsort(src, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
    starts = np.flatnonzero(np.diff(component[order], prepend=-1))
    return ids[order], indptr, dst[by], starts


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each vertex's component: labels hook onto smaller ones, then jump to their ends."""
    label = np.arange(n)
    while (apart := label[a] != label[b]).any():
        x, y = label[a[apart]], label[b[apart]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _blocks(starts: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """(first, last, low, high): sources low to high - 1, whose components are of vertices first to last - 1."""
    firsts = starts[np.flatnonzero(np.diff(starts // PACK, prepend=-1))].tolist()
    blocks = []
    for first, last in zip(firsts, [*firsts[1:], n], strict=False):
        sources = 64 * min(WORDS, max(1, STATE // (4 * WORD.itemsize * (last - first))))
        blocks += [(first, last, low, min(low + sources, last)) for low in range(first, last, sources)]
    return blocks


def _sums(indptr: np.ndarray, cols: np.ndarray, first: int, last: int, low: int, high: int) -> np.ndarray:
    """Each source's sum of 1/dist."""
    k = np.arange(high - low)
    seen = np.zeros((last - first, -(-len(k) // 64)), WORD)
    seen[low - first + k, k // 64] = np.left_shift(np.uint64(1), (k % 64).astype(WORD))
    frontier, active = seen.copy(), low - first + k
    sums, dist = np.zeros(64 * seen.shape[1]), 0
    while len(active):
        dist += 1
        near = np.zeros(last - first, bool)
        near[_ends(indptr, cols, first, active)[0]] = True
        reached = np.flatnonzero(near)
        new = _gathered(frontier, *_ends(indptr, cols, first, reached))
        new &= ~seen[reached]
        frontier[active] = 0
        some = new.any(axis=1)
        active, new = reached[some], new[some]
        seen[active] |= new
        frontier[active] = new
        sums += _by_source(new) / dist
    return sums[: len(k)]


def _ends(indptr: np.ndarray, cols: np.ndarray, first: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The other ends of all links of some vertices, vertex by vertex, and where each vertex's begin."""
    begin, count = indptr[first + rows], indptr[first + rows + 1] - indptr[first + rows]
    offsets = np.cumsum(count) - count
    return cols[np.repeat(begin - offsets, count) + np.arange(count.sum())] - first, offsets


def _gathered(frontier: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits at any of each vertex's ends, gathered piece by piece."""
    out = np.zeros((len(offsets), frontier.shape[1]), WORD)
    step = max(1, PIECE // frontier.shape[1])
    for at in range(0, len(ends), step):
        lo, hi = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, at + step, "left")
        out[lo:hi] |= np.bitwise_or.reduceat(frontier[ends[at : at + step]], np.maximum(offsets[lo:hi] - at, 0), axis=0)
    return out


def _by_source(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit: three rows are added to one of the same weight and one of twice that, until two are left."""
    counts, weight = np.zeros(64 * rows.shape[1], np.int64), 1
    while len(rows):
        carries = [rows[:0]]
        while (k := len(rows) // 3) > 0:
            a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            rows = np.concatenate([odd ^ c, rows[3 * k :]])
        counts += weight * np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        rows, weight = np.concatenate(carries), 2 * weight
    return counts
