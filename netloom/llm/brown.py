"""LM scoring with a Brown class-based bigram model.

P(text) = product over tokens of P(class | class before) * P(word | class), with one
end token a text, which also stands before its first word. Every word of the training
texts has a class found by exchange; none is hashed to one.

1. Word counts cover all training texts (a shuffle by word).
2. The ``OWN`` most frequent words are clustered by exchange proper: each moves to the
   class that raises the classes' mutual information most, until none moves. Their
   bigrams, with all other words as one unit, cover all training texts; this matrix does
   not grow with the corpus, so the exchange runs on the driver.
3. Every other word is moved out of that unit by the same gain: its counts of (class
   before, class after) meet in a shuffle by word, and it goes to the class with which
   mutual information grows most. No such word is a hot key: OWN words are more frequent.
4. Words of ``HEAD`` (a fixed bound) are broadcast with class and count; the tokens of all
   others find theirs by a join on the word, and a second shuffle brings each text's
   classes together. Class transitions are counted over the classes of all training texts.

Smoothing: class transitions are pulled to class frequencies with weight ``PULL``;
emissions add 0.5 to each count and leave 0.5 of each class for words never seen. A word
never seen has no class of its own: the sum over all classes is taken.

Edge cases: a null text is an empty text and has the end token only; a null id counts
as the empty string in the split; repeated rows are scored each; with no training
text every count is 0 and scores stay finite; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import give_back, shared_table, shuffle_partitions, slices, spark_schema, text_bytes

HEAD = 1 << 16
OWN, CLASSES, PULL = 1024, 64, 20.0
END = b""  # no word is empty
_UNSEEN, _LATER = 254, 255  # in place of a class: a word never seen; a word whose class a join brings


def remainder(doc_id: int | None, of: int = 5) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


class _Ids(dict):
    """Known words to their number; other words get the next numbers."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def _training(batches: Iterator[pa.RecordBatch], held_out: int, of: int) -> Iterator[list[list[bytes]]]:
    """The words of training texts, a slice at a time."""
    for b in batches:
        for part in slices(b):
            texts = [t.lower().split() for d, t in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True) if remainder(d, of) != held_out]
            if texts:
                yield texts


def word_counts(docs: DataFrame, held_out: int = 1, of: int = 5) -> DataFrame:
    """(word binary, c): over all texts but those whose remainder is ``held_out``; the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _training(batches, held_out, of):
            c: Counter[bytes] = Counter()
            for words in texts:
                c.update(words)
            c[END] = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])
        give_back()

    return _rows(docs).mapInArrow(count, spark_schema("word binary, c long")).groupBy("word").agg(F.sum("c").alias("c"))


def top_words(counts: DataFrame, size: int) -> pa.Table:
    """The ``size`` most frequent words, ties by the word."""
    return counts.where(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(size).toArrow()


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """A vector of ``size`` from rows (code, n), added up before they reach the driver."""
    got = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out


def unit_bigrams(docs: DataFrame, own: list[bytes], held_out: int = 1, of: int = 5) -> np.ndarray:
    """Counts of adjacent units over all training texts: own words, the end token, all other words."""
    shared, units = docs.sparkSession.sparkContext.broadcast(own), len(own) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, total = {w: i for i, w in enumerate(shared.value)}, np.zeros(units * units, "i8")
        end, other = units - 2, units - 1
        for texts in _training(batches, held_out, of):
            u = np.full(sum(map(len, texts)) + len(texts) + 1, end, "i8")
            at = 1
            for words in texts:
                u[at : at + len(words)] = np.fromiter(map(rank.get, words, repeat(other)), "i8", len(words))
                at += len(words) + 1
            total += np.bincount(u[:-1] * units + u[1:], minlength=units * units)
        code = np.flatnonzero(total)
        for k in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 100_000]), pa.array(total[code[k : k + 100_000]])], ["code", "n"])
        give_back()

    return _summed(_rows(docs).mapInArrow(count, spark_schema("code long, n long")), units * units).reshape(units, units)


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, fixed: int = 1) -> np.ndarray:
    """Class of each unit. The last ``fixed`` units keep classes of their own: ``classes`` and up.

    Units are visited by falling frequency; each moves to the class that raises the
    classes' mutual information most. Ends when no unit moves.
    """
    f = xlogx
    n, k, all_ = len(bigrams), classes, classes + fixed
    freq = bigrams.sum(1) + bigrams.sum(0)
    order = [int(i) for i in np.argsort(-freq, kind="stable") if i < n - fixed]
    of = np.zeros(n, int)
    of[order] = np.arange(len(order)) % k
    of[n - fixed :] = np.arange(k, all_)
    g = between(bigrams, of, all_)
    moved = 1
    while moved:
        moved = 0
        for w in order:
            if not freq[w]:
                continue
            a, s = of[w], bigrams[w, w]
            r, l = np.bincount(of, bigrams[w], all_), np.bincount(of, bigrams[:, w], all_)  # noqa: E741
            r[a] -= s
            l[a] -= s
            g[a] -= r
            g[:, a] -= l
            g[a, a] -= s
            row, col, rs, cs = g.sum(1) + l, g.sum(0) + r, r.sum() + s, l.sum() + s  # the others' sums hold w's bigrams whatever its class
            out, into, d = f(g + r) - f(g), f(g + l[:, None]) - f(g), np.arange(all_)
            gain = out.sum(1) - out[d, d] + into.sum(0) - into[d, d] + f(g[d, d] + r + l + s) - f(g[d, d]) - (f(row + rs) - f(row)) - (f(col + cs) - f(col))
            best = int(np.argmax(gain[:k]))
            if gain[best] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                best = a
            moved += best != a
            of[w] = best
            g[best] += r
            g[:, best] += l
            g[best, best] += s
    return of


def between(bigrams: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of adjacent classes."""
    onehot = np.zeros((len(bigrams), classes))
    onehot[np.arange(len(bigrams)), of] = 1
    return onehot.T @ bigrams @ onehot


class Gains:
    """The class of greatest gain for words that leave the unit of all other words.

    ``g``: counts of adjacent classes, of which the first ``classes`` can be chosen; the
    others are the end token's and that of the other words.
    """

    SMALL = 16

    def __init__(self, g: np.ndarray, classes: int):
        self.k, self.width = classes, len(g)
        small = np.arange(self.SMALL, dtype=float)
        #: for each side, by the class d met there and the class b chosen
        self.sides = [(x, xlogx(x + small[:, None, None]) - xlogx(x)) for x in (g[:, :classes], g[:classes].T)]
        self.sums = [g[:classes].sum(1), g[:, :classes].sum(0)]

    def best(self, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of words 0, 1, ... from rows (word, code, n) sorted by word; code: class before * width + class after."""
        c = np.bincount(word, n)
        total = np.zeros((len(c), self.k))
        for ctx, (x, small) in zip((code // self.width, code % self.width), self.sides, strict=True):
            key, at = np.unique(word * self.width + ctx, return_inverse=True)
            times, d = np.bincount(at, n), key % self.width
            few = times < self.SMALL
            rows = small[np.where(few, times, 0).astype("i8"), d]
            rows[~few] = xlogx(x[d[~few]] + times[~few, None]) - xlogx(x[d[~few]])
            first = np.flatnonzero(np.concatenate([[True], key[1:] // self.width != key[:-1] // self.width]))
            total += np.add.reduceat(rows, first)
        for s in self.sums:
            total -= xlogx(s + c[:, None]) - xlogx(s)
        return total.argmax(1), c.astype("i8")


def contexts(docs: DataFrame, own: list[bytes], class_of: np.ndarray, classes: int, held_out: int = 1, of: int = 5) -> DataFrame:
    """(word, code, n) of all words that are not own, over all training texts; see :class:`Gains` for code."""
    shared, width, size = docs.sparkSession.sparkContext.broadcast((own, class_of.astype("u1"))), classes + 2, len(own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, klass = shared.value
        rank = {w: i for i, w in enumerate(words_)}
        for texts in _training(batches, held_out, of):
            ids = _Ids(rank)
            x = np.full(sum(map(len, texts)) + len(texts) + 1, -1, "i4")
            at = 1
            for words in texts:
                x[at : at + len(words)] = np.fromiter(map(ids.__getitem__, words), "i4", len(words))
                at += len(words) + 1
            c = np.where(x < 0, classes, classes + 1)
            inside = (x >= 0) & (x < size)
            c[inside] = klass[x[inside]]
            place = np.flatnonzero(x >= size)
            if not len(place):
                continue
            key, n = np.unique((x[place].astype("i8") - size) * width**2 + c[place - 1] * width + c[place + 1], return_counts=True)
            spelled = pa.array(list(ids)[size:], pa.binary())
            for k in range(0, len(key), 100_000):
                part = key[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([spelled.take(pa.array(part // width**2)), pa.array((part % width**2).astype("i4")), pa.array(n[k : k + 100_000])], ["word", "code", "n"])
        give_back()

    return _rows(docs).mapInArrow(count, spark_schema("word binary, code int, n long"))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches put together to about ``rows`` rows."""
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if n:
        yield pa.Table.from_batches(some)


def assigned(rows: DataFrame, g: np.ndarray, classes: int) -> DataFrame:
    """(word, c, klass) of :func:`contexts`: each word's count and its class of greatest gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, width = Gains(g, classes), len(g) ** 2

        def judged(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            """Words that are complete; the rows, added up, of the last word if more may follow."""
            words = t["word"].combine_chunks().dictionary_encode()
            if isinstance(words, pa.ChunkedArray):
                words = words.chunk(0)
            index = words.indices.to_numpy().astype("i8")
            key, at = np.unique(index * width + t["code"].to_numpy(), return_inverse=True)
            n = np.bincount(at, t["n"].to_numpy()).astype("i8")
            word, code = key // width, (key % width).astype("i4")
            m = len(words.dictionary)
            cut = len(word) if last else int(np.searchsorted(word, m - 1))
            rest = None if last else pa.table({"word": words.dictionary.take(pa.array(word[cut:])), "code": pa.array(code[cut:]), "n": pa.array(n[cut:])})
            if not cut:
                return None, rest
            klass, c = gains.best(word[:cut], code[:cut], n[:cut])
            return pa.RecordBatch.from_arrays([words.dictionary[: len(c)], pa.array(c), pa.array(klass.astype("i4"))], ["word", "c", "klass"]), rest

        held: pa.Table | None = None
        for t in gathered(batches):
            out, held = judged(t if held is None else pa.concat_tables([held.cast(t.schema), t]), False)
            if out is not None:
                yield out
        if held is not None:
            yield judged(held, True)[0]
        give_back()

    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(run, spark_schema("word binary, c long, klass int"))


@dataclass
class BrownModel:
    own: list[bytes]
    own_counts: np.ndarray
    own_classes: np.ndarray
    vocabulary: DataFrame  # (word, c, klass) of all other words
    classes: int
    tokens: int
    types: int
    ends: int
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # P(class | class before)
    room: np.ndarray = field(default_factory=lambda: np.zeros(0))  # each class's emission denominator

    @property
    def base_room(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.types + 1)))


def cluster(docs: DataFrame, held_out: int = 1, of: int = 5, classes: int = CLASSES, own: int = OWN) -> BrownModel:
    """Counts and a class for every word of the training texts."""
    counts = shared_table(word_counts(docs, held_out, of), "counts")
    tokens, types, ends = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("c")))).first()
    top = top_words(counts, own)
    words = top["word"].to_pylist()
    grid = unit_bigrams(docs, words, held_out, of)
    class_of = exchange(grid, classes, fixed=2)
    rows = contexts(docs, words, class_of[: len(words)], classes, held_out, of)
    vocabulary = shared_table(assigned(rows, between(grid, class_of, classes + 2), classes), "vocabulary")
    return BrownModel(words, top["c"].to_numpy(), class_of[: len(words)], vocabulary, classes, tokens or 0, types, ends or 0)


def class_texts(docs: DataFrame, model: BrownModel, head: int = HEAD) -> DataFrame:
    """(doc_id, seq, n_tokens, n_known, known_logs) for every row.

    seq: a byte for each word, its class or 254 for a word never seen. known_logs: sum of
    log10(count + 0.5) over known tokens, the end token's included.
    """
    more = top_words(model.vocabulary, max(0, head - len(model.own)))
    words = [*model.own, *more["word"].to_pylist()]
    known = np.concatenate([model.own_counts, more["c"].to_numpy()]).astype("i8")
    klass = np.concatenate([model.own_classes, more["klass"].to_numpy()]).astype("u1")
    shared, ends = docs.sparkSession.sparkContext.broadcast((words, known, klass)), model.ends
    ddl = "word binary, rid long, doc_id long, at int, seq binary, n_known long, logs double"
    names = [x.split()[0] for x in ddl.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, klass = shared.value
        rank, size = {w: i for i, w in enumerate(words)}, len(words)
        logs, rid0 = np.log10(counts + 0.5), TaskContext.get().partitionId() << 36
        for batch in batches:
            for b in slices(batch):
                if not b.num_rows:
                    continue
                ids = _Ids(rank)
                lists = [np.fromiter(map(ids.__getitem__, t.lower().split()), "i4") for t in text_bytes(b.column(1))]
                m, end = len(lists), np.cumsum([len(x) for x in lists])
                x = np.concatenate([*lists, np.zeros(0, "i4")])
                doc = np.repeat(np.arange(m), [len(y) for y in lists])
                inside = x < size
                c = np.full(len(x), _LATER, "u1")
                c[inside] = klass[x[inside]]
                n_known = np.bincount(doc[inside], minlength=m) + (ends > 0)
                sums = np.bincount(doc[inside], logs[x[inside]], m) + (np.log10(ends + 0.5) if ends else 0.0)
                seq = [s.tobytes() for s in np.split(c, end[:-1])]
                own = pa.array([b" %d" % (rid0 + k) for k in range(m)], pa.binary())  # no word has a space
                yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(m) + rid0), b.column(0), pa.nulls(m, pa.int32()), pa.array(seq, pa.binary()), pa.array(n_known.astype("i8")), pa.array(sums)], names)
                spelled, place = pa.array(list(ids)[size:], pa.binary()), np.flatnonzero(~inside)
                at = place - (end - [len(y) for y in lists])[doc[place]]
                for k in range(0, len(place), 100_000):
                    p, q = place[k : k + 100_000], at[k : k + 100_000]
                    none = len(p)
                    yield pa.RecordBatch.from_arrays(
                        [spelled.take(pa.array(x[p] - size)), pa.array(doc[p] + rid0), pa.nulls(none, pa.int64()), pa.array(q.astype("i4")), pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.float64())], names
                    )
                rid0 += m
        give_back()

    found = _rows(docs).mapInArrow(emit, spark_schema(ddl)).join(model.vocabulary, "word", "left")
    later = F.col("at").isNotNull()
    by_text = found.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("seq").alias("seq"),
        (F.max("n_known") + F.count(F.when(later, F.col("c")))).alias("n_known"),
        (F.max("logs") + F.coalesce(F.sum(F.log10(F.col("c") + 0.5)), F.lit(0.0))).alias("logs"),
        F.collect_list(F.when(later, F.struct("at", F.coalesce("klass", F.lit(_UNSEEN)).alias("klass")))).alias("later"),
    ).select("doc_id", "seq", "n_known", "logs", F.col("later.at").alias("at"), F.col("later.klass").alias("klass"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                seqs, n = [], []
                for s, at, klass in zip(b.column(1).to_pylist(), b.column(4), b.column(5), strict=True):
                    c = np.frombuffer(s, "u1").copy()
                    c[at.values.to_numpy()] = klass.values.to_numpy()
                    seqs.append(c.tobytes())
                    n.append(len(c) + 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seqs, pa.binary()), pa.array(n, pa.int64()), b.column(2), b.column(3)], ["doc_id", "seq", "n_tokens", "n_known", "known_logs"])
        give_back()

    return by_text.mapInArrow(fill, spark_schema("doc_id long, seq binary, n_tokens long, n_known long, known_logs double"))


def estimate(texts: DataFrame, model: BrownModel, held_out: int = 1, of: int = 5) -> None:
    """Sets the model's transitions and room from the classes of all training texts."""
    k = model.classes + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, end = np.zeros(k * k, "i8"), bytes([k - 1])
        for b in batches:
            seqs = [s for d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if remainder(d, of) != held_out]
            c = np.frombuffer(end + b"".join([s + end for s in seqs]), "u1").astype("i8")
            total += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    pairs = _summed(texts.select("doc_id", "seq").mapInArrow(count, spark_schema("code long, n long")), k * k).reshape(k, k)
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * k)
    model.transitions = (pairs + PULL * share) / (pairs.sum(1, keepdims=True) + PULL)
    sums = model.vocabulary.groupBy("klass").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    n, v = np.bincount(model.own_classes, model.own_counts, k), np.bincount(model.own_classes, minlength=k).astype(float)
    n[sums["klass"].to_numpy()] += sums["n"].to_numpy()
    v[sums["klass"].to_numpy()] += sums["v"].to_numpy()
    n[-1], v[-1] = model.ends, model.ends > 0
    model.room = n + 0.5 * (v + 1)


class Chain:
    """log10 probabilities of class sequences, with any class for words never seen."""

    def __init__(self, transitions: np.ndarray, room: np.ndarray):
        self.k, self.step, self.room = len(room), transitions, np.log10(room)
        self.logs = np.log10(transitions)
        hidden = 0.5 / room
        hidden[-1] = 0.0  # the end token's class has no other word
        self.powers = [self._scaled(hidden[:, None] * transitions, 0.0)]
        self.gaps: dict[int, np.ndarray] = {}

    @staticmethod
    def _scaled(m: np.ndarray, log: float) -> tuple[np.ndarray, float]:
        top = m.max()
        return m / top, log + float(np.log10(top))

    def gap(self, n: int) -> np.ndarray:
        """log10 of the way from each class to each over ``n`` words never seen."""
        if n not in self.gaps:
            m, log = self.step, 0.0
            for bit in range(n.bit_length()):
                if bit == len(self.powers):
                    half, by = self.powers[-1]
                    self.powers.append(self._scaled(half @ half, 2 * by))
                if n >> bit & 1:
                    m, log = self._scaled(m @ self.powers[bit][0], log + self.powers[bit][1])
            with np.errstate(divide="ignore"):
                found = np.log10(m) + log
            if len(self.gaps) > 256:
                self.gaps.clear()
            self.gaps[n] = found
        return self.gaps[n]

    def score(self, seq: bytes) -> float:
        """Without the known words' log10(count + 0.5)."""
        c = np.frombuffer(bytes([self.k - 1]) + seq + bytes([self.k - 1]), "u1")
        at = np.flatnonzero(c != _UNSEEN)
        kept = c[at].astype("i8")
        n = np.diff(at) - 1
        out = -self.room[kept[1:]].sum() + self.logs[kept[:-1], kept[1:]][n == 0].sum()
        for size in np.unique(n[n > 0]).tolist():
            here = n == size
            out += self.gap(size)[kept[:-1][here], kept[1:][here]].sum()
        return float(out)


def score(texts: DataFrame, model: BrownModel, held_out: int = 1, of: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    transitions, room, tokens, base_room = model.transitions, model.room, model.tokens, model.base_room
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(transitions, room)
        for b in batches:
            if not b.num_rows:
                continue
            n, known, logs = (b.column(k).to_numpy() for k in (2, 3, 4))
            total = logs + np.array([chain.score(s) for s in b.column(1).to_pylist()])
            base = logs + (n - known) * np.log10(0.5) - n * base_room
            held = pa.array([remainder(d, of) == held_out for d in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), held, pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens, "i8")), pa.array(base), pa.array(total), pa.array(10 ** (-total / n))], [x.split()[0] for x in ddl.split(", ")]
            )

    return texts.mapInArrow(run, spark_schema(ddl))


def brown_scores(docs: DataFrame, head: int = HEAD, own: int = OWN, classes: int = CLASSES) -> DataFrame:
    """Fit on the training texts and score every text; ``head`` bounds a broadcast and changes no result."""
    model = cluster(docs, own=own, classes=classes)
    texts = shared_table(class_texts(docs, model, head), "class_texts")
    estimate(texts, model)
    return score(texts, model)
