"""Toxicity: Levenshtein automata over a lexicon trie, with context windows for quotation.

Lexicon. Words and word beginnings that stand in toxic training texts in many
different contexts (counted by the word before them, so that copies of one text count
once) and hardly in clean ones, counted over every labelled row that is not held out. A
term needs ``MIN_CONTEXTS`` and a ``MIN_SHARE`` of the toxic texts; as a text adds to the
count of its own words only, there are at most (distinct words of a toxic text on
average) / MIN_SHARE words, however many rows there are, and that bounds the broadcast.
Labels meet texts in a join; a bitmap of hashed ids (8 MB at most) first drops most texts
that have no label, so that about the labelled ones are shuffled, once.

Matching. A text's word is turned into a Levenshtein automaton that walks the lexicon
trie: whole-word terms of four letters or more match with one edit, also those that
start with a chosen beginning; shorter ones and beginnings match exactly. A worker
remembers the words it has met.

Scoring. A match inside quotation marks counts as quoted, else as used; the window of
words around it adds its neighbours that match too. A logistic regression
over these counts gives the score. Its weights alone are fitted on at most
``MAX_TRAINING_ROWS`` labelled rows (chosen by a hash of the id), none of them held out.

Edge cases: a null or empty text has no match and gets the score of no match; null
labels do not train; without both labels in the training rows every score is the
share of toxic rows among them (0 if there are none); repeated rows are scored alike;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import map_arrow, spark_schema

MAX_TRAINING_ROWS = 20_000
BITS, MOST_BITS = 16, 1 << 26  # of the bitmap of labelled ids: for each, and in all
WINDOW = 8
CACHE = 400_000
MIN_CONTEXTS, MIN_SHARE, MIN_ODDS = 6, 0.0005, 2.5
LEAST = 4  # letters of a term that matches with an edit
_WORD = re.compile(r"\w+|[\"«»„“”‹›]")
_OPEN, _CLOSE = set("«„“‹\""), set("»”“›\"")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores, and single quotation marks."""
    return _WORD.findall((text or "").lower())


Term = tuple[str, bool, float]  # term, whether it is a beginning, its log odds


@dataclass
class Trie:
    """Lexicon terms; a node has the weight of the word, and of the beginning, that ends there."""

    kids: list[dict[str, int]] = field(default_factory=lambda: [{}])
    whole: list[float] = field(default_factory=lambda: [0.0])
    beginning: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def of(cls, terms: list[Term]) -> Trie:
        t = cls()
        for term, beginning, weight in terms:
            at = 0
            for ch in term:
                nxt = t.kids[at].get(ch)
                if nxt is None:
                    nxt = t.kids[at][ch] = len(t.kids)
                    t.kids.append({})
                    t.whole.append(0.0)
                    t.beginning.append(0.0)
                    t.depth.append(t.depth[at] + 1)
                at = nxt
            into = t.beginning if beginning else t.whole
            into[at] = max(into[at], weight)
        return t

    def match(self, word: str, edits: int = 1, least: int = 5) -> tuple[float, float]:
        """The heaviest term that ``word`` is or begins with, and the heaviest that it is but for an edit.

        The automaton's states are (letters of ``word`` read, edits made); a state is
        dropped if another reaches it with fewer edits.
        """
        n, exact, near = len(word), 0.0, 0.0
        stack: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ((0, 0),))]
        while stack:
            node, states = stack.pop()
            whole, beginning = self.whole[node], self.beginning[node]
            if whole or beginning:
                for i, e in states:
                    if e == 0:
                        exact = max(exact, beginning, whole if i == n else 0.0)
                    if whole > near and n - i + e <= edits and self.depth[node] >= least:
                        near = whole
            for ch, kid in self.kids[node].items():
                after = step(word, states, ch, edits)
                if after:
                    stack.append((kid, after))
        return exact, near


def step(word: str, states: tuple[tuple[int, int], ...], ch: str, edits: int) -> tuple[tuple[int, int], ...]:
    """States of the Levenshtein automaton of ``word`` after reading ``ch``."""
    n, best = len(word), {}
    for i, e in states:
        if i < n and word[i] == ch and best.get(i + 1, edits + 1) > e:
            best[i + 1] = e
        if e < edits:
            for j, f in ((i, e + 1), (i + 1, e + 1)):  # a letter too many in the term; another letter
                if j <= n and best.get(j, edits + 1) > f:
                    best[j] = f
            for d in range(1, edits - e + 1):  # letters of the word that the term lacks
                j = i + d
                if j < n and word[j] == ch and best.get(j + 1, edits + 1) > e + d:
                    best[j + 1] = e + d
    return tuple(best.items())


_NONE = (0.0, 0.0)


class Matcher:
    """Weights of words, remembered, and features of texts.

    A word within one edit of a term has the term's first or second half unchanged at
    its own beginning or end; words with neither, nor a beginning, are not looked up.
    """

    def __init__(self, terms: list[Term]):
        self.trie = Trie.of(terms)
        whole = {t for t, beginning, _ in terms if not beginning}
        long = {t for t in whole if len(t) >= LEAST}
        self.heads = {t for t, beginning, _ in terms if beginning} | {t for t in whole if len(t) < LEAST} | {t[: len(t) // 2] for t in long}
        self.tails = {t[len(t) // 2 :] for t in long}
        self.head_sizes, self.tail_sizes = sorted({len(t) for t in self.heads}), sorted({len(t) for t in self.tails})
        self.new: dict[str, tuple[float, float]] = {}
        self.old: dict[str, tuple[float, float]] = {}

    def weights(self, words: list[str]) -> list[tuple[float, float]]:
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}
        new, old, match = self.new, self.old, self.trie.match
        heads, tails, head_sizes, tail_sizes = self.heads, self.tails, self.head_sizes, self.tail_sizes
        for w in set(words):
            if w in new:
                continue
            found = old.get(w)
            if found is None:
                maybe = any(w[:k] in heads for k in head_sizes) or any(w[-k:] in tails for k in tail_sizes)
                found = match(w, least=LEAST) if maybe else _NONE
                if found == _NONE:
                    found = _NONE
            new[w] = found
        return [new[w] for w in words]

    def features(self, text: str | None) -> list[float]:
        """Weights of terms used (all, heaviest, heaviest window, a hundred words), with an edit, quoted."""
        words = words_of(text)
        weights = self.weights(words)
        at = [i for i, (a, b) in enumerate(weights) if a or b]
        if not at:
            return [0.0] * FEATURES
        quoted = quotation(words)
        used = {i: weights[i][0] for i in at if weights[i][0] and not quoted[i]}
        near = sum(weights[i][1] for i in at if not weights[i][0] and not quoted[i])
        cited = sum(max(weights[i]) for i in at if quoted[i])
        total, window, lo, places = 0.0, 0.0, 0, list(used)
        for i in places:  # a sliding window over the places of terms
            total += used[i]
            while i - places[lo] > WINDOW:
                total -= used[places[lo]]
                lo += 1
            window = max(window, total)
        s = sum(used.values())
        return [np.log1p(s), max(used.values(), default=0.0), np.log1p(window), min(100.0 * s / len(words), 50.0), np.log1p(near), np.log1p(cited)]


FEATURES = 6


def quotation(words: list[str]) -> list[bool]:
    """Whether each word stands between an opening mark and the next closing one, ``4 * WINDOW`` words on at most."""
    out, opened = [False] * len(words), -1
    for i, w in enumerate(words):
        if opened >= 0 and w in _CLOSE:
            if i - opened <= 4 * WINDOW:
                out[opened : i + 1] = [True] * (i + 1 - opened)
                opened = -1
            else:
                opened = i if w in _OPEN else -1
        elif w in _OPEN:
            opened = i
    return out


def remainder(doc_id: int | None, of: int = 3) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


def marked_ids(labels: DataFrame, held_out: int = 1, of: int = 3, most: int | None = None) -> DataFrame:
    """(doc_id, toxic) of the labels that are not held out, or of about ``most`` of them."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marked = marked.where((F.pmod(F.crc32(key.cast("binary")), F.lit(of)) != held_out) & F.col("doc_id").isNotNull())
    if most is not None and (n := marked.count()) > most:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return marked


def likely_rows(docs: DataFrame, ids: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, text) of every row whose id is in ``ids``, and of a few others: a join must follow.

    The others are those whose id's hash meets that of one in ``ids`` in a bitmap of
    ``BITS`` to twice as many bits an id, up to ``most_bits``.
    """
    size = min(most_bits, 64 << (BITS * ids.count() // 64).bit_length())
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(size).cast("long"))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    got = ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    words = np.zeros(size // 64, "i8")
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    bitmap = docs.sparkSession.createDataFrame(pa.table({"bitmap": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))}))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = F.call_function("shiftright", F.col("bitmap")[word.cast("int")], bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.join(F.broadcast(bitmap), met).drop("bitmap")


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int = 1, of: int = 3) -> DataFrame:
    """(text, toxic) of the labelled rows that are not held out.

    The join is by a shuffle whatever the size of the labels, which grow with the
    documents; only the texts of likely rows are in it.
    """
    marked = marked_ids(labels, held_out, of)
    return likely_rows(docs, marked).join(marked.hint("merge"), "doc_id").select("text", "toxic")


def learn_lexicon(rows: DataFrame) -> list[Term]:
    """The terms, those of most contexts first."""

    def contexts(b: pa.RecordBatch) -> pa.RecordBatch | None:
        word, before, toxic, first = [], [], [], []
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = words_of(t)
            pairs = set(zip(words, ["", *words], strict=False)) if y else {(w, None) for w in words}
            word += [p[0] for p in pairs]
            before += [p[1] for p in pairs]
            toxic += [y] * len(pairs)
            met: set[str] = set()
            for w, _ in pairs:
                first.append(int(w not in met))
                met.add(w)
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(before, pa.string()), pa.array(toxic, pa.int32()), pa.array(first, pa.int32())], ["word", "before", "toxic", "first"])

    pairs = map_arrow(rows.select("text", F.col("toxic").cast("int").alias("toxic")), contexts, "word string, before string, toxic int, first int")
    y = F.col("toxic") == 1
    n = rows.agg(F.sum(F.col("toxic")).alias("t"), F.count("*").alias("n")).first()
    bad, good = n["t"] or 0, (n["n"] or 0) - (n["t"] or 0)
    least = max(MIN_CONTEXTS, math.ceil(MIN_SHARE * bad))
    per_pair = pairs.groupBy("word", "before", "toxic").agg(F.count("*").alias("k"), F.sum("first").alias("d"))
    per_word = per_pair.groupBy("word").agg(F.sum(y.cast("long")).alias("contexts"), F.sum(F.when(y, F.col("d")).otherwise(0)).alias("d"), F.sum(F.when(y, 0).otherwise(F.col("k"))).alias("c"))
    per_word = per_word.withColumn("t", F.least("contexts", "d"))
    odds = F.log((F.col("t") + 0.5) / (bad + 1.0)) - F.log((F.col("c") + 0.5) / (good + 1.0))
    chosen = (F.col("t") >= least) & (odds >= MIN_ODDS) & (F.length("term") >= 3)
    per_word = per_word.where("word is not null").cache()
    starts = per_word.select(F.explode(F.transform(F.sequence(F.lit(3), F.lit(8)), lambda k: F.substring("word", F.lit(1), k))).alias("term"), "word", "t", "c").where(F.length("word") > F.length("term"))
    starts = starts.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") >= 2).cast("long")).alias("forms")).where(chosen & (F.col("forms") >= 5))
    whole = per_word.withColumnRenamed("word", "term").where(chosen)
    both = whole.select("term", "t", "c", F.lit(False).alias("beginning")).unionByName(starts.select("term", "t", "c", F.lit(True).alias("beginning")))
    terms = [(r["term"], r["beginning"], r["odds"]) for r in both.withColumn("odds", odds).orderBy(F.desc("t"), "term", "beginning").collect()]
    per_word.unpersist()
    return terms


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights with the intercept first, by Newton steps; the intercept is not shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w = w + change
        if np.abs(change).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 1, of: int = 3, most: int = MAX_TRAINING_ROWS) -> tuple[list[Term], np.ndarray]:
    terms = learn_lexicon(training_rows(docs, labels, held_out, of))
    marked = marked_ids(labels, held_out, of, most)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def batch(b: pa.RecordBatch, m: Matcher) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([m.features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    found = map_arrow(likely_rows(docs, marked), batch, "doc_id long, x array<double>", lambda: Matcher(shared.value))  # no text is shuffled
    got = found.join(marked, "doc_id").select("x", F.col("toxic").cast("int").alias("y")).toArrow()
    x, y = np.array(got["x"].to_pylist(), float).reshape(-1, FEATURES), got["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        share = y.mean() if len(y) else 0.0
        return terms, np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), *[0.0] * FEATURES])
    return terms, logistic(x, y)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 1, of: int = 3, threshold: float = 0.7, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    terms, weights = fit(docs, labels, held_out, of, most)
    shared = docs.sparkSession.sparkContext.broadcast((terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = shared.value
        m = Matcher(words)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            x = np.array([m.features(t) for t in b.column(1).to_pylist()])
            s = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([remainder(i, of) == held_out for i in ids]), pa.array(s), pa.array((s >= threshold).astype("i4"))], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, spark_schema("doc_id long, held_out boolean, score double, predicted int"))
