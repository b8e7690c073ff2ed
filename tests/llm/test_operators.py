"""Each operator against a brute-force version, with nulls, blanks, long texts, copies and empty tables."""

import collections
import hashlib
import json
import math
import random
import sys
import zlib

import numpy as np
import pytest
from helpers import WORD, frame, lower, remainder, texts, words

from netloom.llm import bpe, brown, chat, common, components, exact_dedup, minhash, mixing, quality, repeats, suffixes, token_store, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return common.shared_table(frame(spark), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def by_id():
    return {r[0]: r[1] for r in texts()}


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_exact_dedup(docs, none, by_id):
    groups = collections.defaultdict(list)
    for i, t in by_id.items():
        groups[lower(t)].append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_groups(docs, keep).collect()
        assert len(got) == len(by_id)
        for r in got:
            g = groups[lower(by_id[r.doc_id])]
            assert (r.keep_id, r.group_size, r.kept) == (best(g), len(g), r.doc_id == best(g))
            assert r.text_sha256 == hashlib.sha256(lower(by_id[r.doc_id]).encode()).hexdigest()
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_tells_collisions_apart(docs, by_id):
    got = exact_dedup.exact_groups(docs, "largest", hashed=lambda x: b"same").collect()
    sizes = collections.Counter(lower(t) for t in by_id.values())
    assert all(r.group_size == sizes[lower(by_id[r.doc_id])] for r in got) and sum(r.kept for r in got) == len(sizes)


def test_exact_dedup_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "A"), (1, "b"), (None, "c"), (None, "c"), (None, "a")], "doc_id long, text string")
    got = exact_dedup.exact_groups(df, "largest")
    assert got.count() == 6 and got.where("kept").count() == 3
    assert exact_dedup.exact_dedup(df, "largest").count() == 3


def test_mixing(docs, none):
    got = mixing.mix(docs, with_source=True).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in texts()}
    sources = collections.Counter()
    for r in texts():
        sources[r[3]] += size[r[0]]
    order = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sources.values()), set()
    while True:
        level = (total - sum(2 * sources[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and 2 * sources[s] <= level * weight[s]}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in got:
        want = 2.0 * sources[r.source] if r.source in capped else level * weight[r.source]
        assert r["size"] == size[r.doc_id] and r.source_size == sources[r.source] and abs(r.target - want) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 0.5 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), with_source=True).collect()))
    assert mixing.mix(none).count() == 0
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in copies.select("text").collect()) == sum(taken.values())


def test_quality(docs, none, by_id):
    def brute(x):
        w = WORD.findall(x)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [y for y in x.split("\n") if WORD.search(y)]
        return len(w), sum(map(len, w)), sum(x.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    got = quality.quality_report(docs).collect()
    assert len(got) == len(by_id)
    for r in got:
        want = brute(by_id[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    cells = {r.rule: (r.failed, r.alone) for r in quality.ablation(quality.ledger(docs)).collect()}
    assert cells["few_words"][0] == sum(r.n_words < 20 for r in got) and cells["few_words"][1] == sum(r.fail_bits == 1 for r in got)
    assert quality.quality_report(none).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bpe(docs, none, by_id, library):
    got = bpe.bpe_digest(docs).collect()
    assert len(got) == len(by_id)
    for r in got:
        ids = library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_documents(docs)
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded).collect()}
    assert all(back[r.doc_id] == library.decode(r.ids, skip_special_tokens=False) for r in encoded.collect())
    assert bpe.bpe_digest(none).count() == 0


def test_bpe_on_random_characters(library):
    own, r = bpe.Bpe(bpe.read_spec()), random.Random(4)
    pool = ["a", "B", "é", "Σ", "'s", "'", " ", "\n", "\x85", "\x1c", "1", "٣", "!", "<|endoftext|>", "<|", "́", "İ", "ß", "漢"]
    for _ in range(1500):
        t = "".join(r.choice([*pool, chr(r.randrange(32, 0x3000))]) for _ in range(r.randrange(20)))
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t.encode()) == np.array(want, "<u4").tobytes()
        assert token_store.LibraryEncoder.of(bpe.read_spec()).encode(t.encode()) == np.array(want, "<u4").tobytes()


def test_bpe_merges_short_pieces_side_by_side(library, monkeypatch):
    """A tree of its own for each new piece took op2_bpe past its CPU budget."""
    leaves, tree, r = [], bpe.PairTree, random.Random(6)
    monkeypatch.setattr(bpe, "PairTree", lambda keys: leaves.append(len(keys)) or tree(keys))
    monkeypatch.setattr(bpe, "BLOCK", 100, raising=False)
    sizes = [1, 2, 3, 4, 7, 8, 15, 16, 17, 31, 32, 33, 62, 63, 64, 65, 300]
    words_ = ["".join(r.choice(pool) for _ in range(r.choice(sizes))) for pool in ("aaab", "etaoinshr", "thé漢Σİ", "an'<|!1") for _ in range(1000)]
    text = " ".join([*words_, "<|endoftext|>", *r.sample(words_, 500)])
    want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert all(bpe.Bpe(bpe.read_spec(), cache).encode(text.encode()) == want for cache in (0, 100_000, bpe.CACHE))
    assert min(leaves) >= 63


def test_token_store(docs, none, by_id, library, spark, tmp_path):
    manifest = token_store.write_store(docs, f"file://{tmp_path}/tokens")
    got = {r.doc_id: r for r in token_store.read_store(manifest).collect()}
    start = 0
    for i in sorted(by_id):
        ids = library.encode(by_id[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_store.lookup(manifest, spark.createDataFrame([(min(by_id),), (10**9,)], "doc_id long")).collect()
    assert [r.doc_id for r in some] == [min(by_id)] and len(some[0].ids) == got[min(by_id)].n_tokens
    assert token_store.store_digest(none).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "b c"), (None, "d"), (None, None)], "doc_id long, text string")
    assert token_store.store_digest(twice).count() == 4


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000, dtype="u8"))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_brown(docs, none, by_id):
    tokens = {i: [*words(t), ""] for i, t in by_id.items()}
    count = collections.Counter(w for i, ws in tokens.items() if remainder(i, 5) != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    got = brown.brown_scores(docs).collect()
    assert len(got) == len(by_id)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 5) == 1, len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert brown.brown_scores(none).count() == 0


def test_brown_score_by_brute_force(docs, by_id):
    """P(text) summed over all classes of words never seen, from the classes that the model gives and counts made here."""
    model = brown.cluster(docs, own=12, classes=4)
    klass = dict(zip(model.own, model.own_classes.tolist())) | {bytes(r.word): r.klass for r in model.vocabulary.collect()}
    train = [[w.encode() for w in words(t)] for i, t in by_id.items() if remainder(i, 5) != 1]
    count = collections.Counter(w for t in train for w in t)
    assert set(klass) == set(count) and {bytes(r.word): r.c for r in model.vocabulary.collect()} == {w: c for w, c in count.items() if w not in model.own}
    chains = [[4, *[klass[w] for w in t], 4] for t in train]
    pairs = collections.Counter(p for c in chains for p in zip(c, c[1:]))
    total, into, out_ = sum(pairs.values()), collections.Counter(), collections.Counter()
    for (x, y), k in pairs.items():
        out_[x] += k
        into[y] += k
    share = [(into[y] + 0.5) / (total + 2.5) for y in range(5)]
    step = [[(pairs[x, y] + brown.PULL * share[y]) / (out_[x] + brown.PULL) for y in range(5)] for x in range(5)]
    n, v = collections.Counter({4: len(train)}), collections.Counter({4: 1})
    for w, c in count.items():
        n[klass[w]] += c
        v[klass[w]] += 1
    room = [n[y] + 0.5 * (v[y] + 1) for y in range(5)]

    def brute(ws):
        now, log = [0.0] * 4 + [1.0], 0.0
        for w in [*ws, None]:
            if w is None or w in klass:
                emit = [0.0] * 5
                y = 4 if w is None else klass[w]
                emit[y] = ((len(train) if w is None else count[w]) + 0.5) / room[y]
            else:
                emit = [0.5 / room[y] for y in range(4)] + [0.0]
            now = [sum(now[x] * step[x][y] for x in range(5)) * emit[y] for y in range(5)]
            log += math.log10(sum(now))
            now = [x / sum(now) for x in now]
        return log

    for head in (15, 1000):
        got = {r.doc_id: r.score for r in brown.brown_scores(docs, head=head, own=12, classes=4).collect()}
        assert all(math.isclose(got[i], brute([w.encode() for w in words(t)]), rel_tol=1e-9) for i, t in by_id.items())


def test_brown_words_outside_the_head(docs):
    whole = {r.doc_id: r for r in brown.brown_scores(docs).collect()}
    few = {r.doc_id: r for r in brown.brown_scores(docs, head=20).collect()}
    assert all(few[i].n_known == r.n_known and math.isclose(few[i].base_score, r.base_score, rel_tol=1e-9) for i, r in whole.items())
    assert brown.brown_scores(docs.where("text is null")).where("n_tokens = 1").count() == 2


def test_other_words_go_to_the_class_of_greatest_gain():
    r = np.random.default_rng(7)
    units = r.integers(0, 40, (9, 9)).astype(float)  # 7 own units, the end, all other words
    of = np.array([0, 1, 2, 0, 1, 2, 0, 3, 4])
    g = brown.between(units, of, 5)
    mi = lambda m: brown.xlogx(m).sum() - brown.xlogx(m.sum(0)).sum() - brown.xlogx(m.sum(1)).sum()
    word, code, n = [], [], []
    for w in range(30):
        for x in sorted(r.choice(16, r.integers(1, 6), replace=False).tolist()):  # contexts among classes 0..3
            word.append(w)
            code.append(x // 4 * 5 + x % 4)
            n.append(int(r.integers(1, 25)))
    word, code, n = np.array(word), np.array(code), np.array(n)
    klass, c = brown.Gains(g, 3).best(word, code, n)
    for w in range(30):
        gains = []
        for b in range(3):
            m = g.copy()
            for x, k in zip(code[word == w], n[word == w]):
                m[x // 5, b] += k
                m[b, x % 5] += k
            gains.append(mi(m))
        assert c[w] == n[word == w].sum() and np.isclose(gains[klass[w]], max(gains))


def test_exchange_finds_alternating_classes():
    r = np.random.default_rng(1)
    grid = np.zeros((21, 21))
    for _ in range(4000):
        a, b = r.integers(0, 10), 10 + r.integers(0, 10)
        grid[a, b] += 1
        grid[b, r.integers(0, 10)] += 1
    of = brown.exchange(grid, classes=2)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10]


def test_near_duplicates(docs, none, by_id):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in by_id.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == sum(find(i) == i for i in sets)
    assert minhash.near_duplicates(none).count() == 0


def test_blocks_lose_no_link(monkeypatch):
    """Members in blocks of two sides give the links that all pairs give."""
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 60, 80, dtype="u8")
    sets = [np.unique(np.concatenate([base[r.random(80) < 0.93], r.integers(0, 1 << 60, r.integers(0, 12), dtype="u8")])) for _ in range(90)]
    n, tokens, owners = np.array([len(s) for s in sets]), np.concatenate(sets), np.repeat(np.arange(90), [len(s) for s in sets])
    want = {(i, j) for i in range(90) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    parts = [np.arange(0, 45), np.arange(45, 90)]
    links = [e for a, b in ((0, 0), (0, 1), (1, 1)) for e in minhash.links_between(n, tokens, owners, parts[a], parts[b], 75)]
    assert all((max(e), min(e)) in want for e in links)

    def groups(edges):
        of = list(range(90))
        for _ in range(90):
            for i, j in edges:
                of[i] = of[j] = min(of[i], of[j])
        return of

    assert groups(links) == groups(want)


def test_bands_miss_hardly_any_similar_pair():
    r, missed = np.random.default_rng(3), 0
    for n in (4, 8, 40, 200):
        for _ in range(300):
            u = np.unique(r.integers(0, 1 << 63, n, dtype="u8") * np.uint64(2))
            k = math.ceil(0.75 * len(u))
            half = k + (len(u) - k) // 2
            missed += not np.intersect1d(minhash.bands(u[:half]), minhash.bands(np.unique(np.concatenate([u[:k], u[half:]])))).size
    assert missed == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3), (101, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_arrays():
    r = random.Random(5)
    for _ in range(400):
        data = bytes(r.randrange(1, r.choice([2, 3, 9])) for _ in range(r.randrange(1, 50))) * r.choice([1, 1, 3])
        t, want = np.frombuffer(data, "u1"), sorted(range(len(data)), key=lambda i: data[i:])
        for sigma in (256, 600):
            assert suffixes.suffix_array(t.astype("i8"), sigma).tolist() == want
        shared = dict.fromkeys(range(len(data)), 0)
        for x, y in zip(want, want[1:]):
            while shared[y] < 6 and max(x, y) + shared[y] < len(data) and data[x + shared[y]] == data[y + shared[y]]:
                shared[y] += 1
        assert suffixes.common_prefixes(t, np.array(want), 6).tolist() == [shared[i] for i in range(len(data))]


def test_suffixes_of_reduced_strings_are_not_sorted_one_by_one():
    r = random.Random(6)
    once = bytes(r.choice(b"abcd") for _ in range(6000))
    for data in (once * 2 + once[:999], b"abcabd" * 2000):
        lines = [0]

        def count(frame, event, arg, lines=lines):
            lines[0] += event == "line"
            return count if frame.f_code.co_filename == suffixes.__file__ else None

        before = sys.gettrace()
        sys.settrace(count)
        try:
            got = suffixes.suffix_array(np.frombuffer(data, "u1").astype("i8"), 256)
        finally:
            sys.settrace(before)
        assert got.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        assert lines[0] < len(data) / 4  # a line for each of them would be as many as a third, or more


def removed(rows, length):
    data = {i: (t or "").encode() for i, t in rows}
    count = collections.Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in data.items():
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_repeats(spark, docs, none, by_id, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.repeats_digest(docs).collect()}
    assert got == removed(by_id.items(), 400) and sum(x[1] for x in got.values()) > 0
    assert repeats.repeats_digest(none).count() == 0


def test_repeats_within_a_text(spark):
    rows = [(1, "a" * 1000), (2, "ab" * 700), (3, None), (4, "x" * 400), (5, "x" * 400), (6, "y" * 401), (7, "z" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:5] for r in repeats.repeats_digest(df).collect()} == removed(rows, 400)
    assert {r.doc_id: len(r.kept) for r in repeats.remove_repeats(df).collect()}[7] == 400


def test_shared_passages(spark, none):
    """Sure from PASSAGE words on, none below NOISE words, whatever stands around them."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    rows, sure, never = [], set(), set()
    for k in range(60):
        size = r.choice([20, 29, 44, 50, 51, 70, 300])
        passage = [word() for _ in range(size)]
        for j in range(2):
            rows.append((2 * k + j, " ".join([*[word() for _ in range(r.randrange(90))], *(w.upper() if j else w for w in passage), *[word() for _ in range(r.randrange(90))]]).replace(" ", "\n" if j else " ")))
            (sure if size >= 50 else never if size < 30 else set()).add(2 * k + j)
    rows += [(500, None), (501, ""), (None, "x " * 100), (None, "x " * 100), (502, "y " * 100)]
    got = {r.doc_id for r in repeats.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sure <= got and not never & got and None in got and not {500, 501, 502} & got
    assert repeats.shared_passages(none).count() == 0
    text = " ".join(word() for _ in range(4000)).encode()
    small = repeats.Winnow()
    small.STEP = 64
    assert small.of(text).tolist() == repeats.Winnow().of(text).tolist()


def test_chat(spark):
    call = '{"tool_calls": [{"id": "b", "name": "add", "arguments": {"x": {"$ref": "a"}}}, {"id": "a", "name": "get", "arguments": {"k": "é"}}]}'
    rows = [(1, 0, "user", "hi\n{"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id": "a", "content": 3}'), (2, 0, "tool", '{"tool_call_id": "b"}'), (None, None, None, None), (1, 0, "user", "hi\n{"), (3, 0, "assistant", "{broken")]
    schemas = {"get": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string"}}, "additionalProperties": False}, "add": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as calls", "2 as row"), schemas).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.n_calls)
    assert (one.n_calls, one.n_linked, one.n_invalid) == (2, 1, 1)
    assert one.line == '{"role":"assistant","tool_calls":[{"arguments":{"k":"é"},"id":"a","level":0,"name":"get","result_turn":2,"valid":true},{"arguments":{"x":{"$ref":"a"}},"id":"b","level":1,"name":"add","result_turn":null,"valid":false}],"turn":1}'
    assert sum(r.line == '{"content":"hi\\n{","role":"user","turn":0}' for r in got) == 2
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_cycles_get_no_level(spark):
    text = '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": {"$ref": "b"}}}, {"id": "b", "name": "f", "arguments": [{"$ref": "a"}]}, {"id": "c", "name": "f"}]}'
    line = chat.format_chat(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")).first().line
    assert line.count('"level":null') == 2 and line.index('"id":"c"') < line.index('"id":"a"')


def test_chat_keeps_content_and_other_fields(spark):
    call = '{"content": "let me look \\ud800", "mood": [1], "turn": "x", "tool_calls": [{"id": "a", "name": "f", "type": "function", "level": "low"}]}'
    result = '{"tool_call_id": "a", "result": {"k": null}, "role": "server"}'
    rows = [(1, 0, "assistant", call), (1, 1, "tool", result)]
    got = {r.turn: r.line for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[0] == (
        '{"content":"let me look \\ud800","mood":[1],"own":{"turn":"x"},"role":"assistant","tool_calls":[{"arguments":{},"id":"a","level":0,"name":"f","own":{"level":"low"},"result_turn":1,"type":"function","valid":null}],"turn":0}'
    )
    assert got[1] == '{"content":null,"own":{"role":"server"},"result":{"k":null},"role":"tool","tool_call_id":"a","turn":1}'


def test_chat_links_and_validates_as_brute_force(spark):
    r, schemas = random.Random(9), {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}
    rows, calls, answers = [], {}, collections.defaultdict(set)
    for conv in range(30):
        for turn in range(12):
            if turn % 2:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": (i := f"c{r.randrange(14)}"), "content": turn})))
                answers[conv].add(i)
            else:
                made = [{"id": f"c{r.randrange(14)}", "name": r.choice("fg"), "arguments": r.choice([{"x": 1}, {"x": "1"}, {}, {"x": True}])} for _ in range(r.randrange(4))]
                calls[conv, turn] = made
                rows.append((conv, turn, "assistant", json.dumps({"content": "c", "tool_calls": made})))
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), schemas).collect()
    assert len(got) == len(rows)
    for x in got:
        made = calls.get((x.conv_id, x.turn), [])
        bad = sum(c["name"] == "f" and c["arguments"] != {"x": 1} or c["name"] == "f" and c["arguments"]["x"] is True for c in made)
        assert (x.n_calls, x.n_linked, x.n_invalid) == (len(made), sum(c["id"] in answers[x.conv_id] for c in made), bad)
    assert sum(x.n_linked for x in got) and sum(x.n_invalid for x in got)


def test_levenshtein_automaton():
    r = random.Random(6)

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            prev, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], min(prev + (x != y), row[j] + 1, row[j + 1] + 1)
        return row[-1] <= 1

    for _ in range(3000):
        terms = ["".join(r.choice("ab") for _ in range(r.randrange(3, 7))) for _ in range(3)]
        q = "".join(r.choice("ab") for _ in range(r.randrange(8)))
        got = toxicity.Trie.of([(t, False, 1.0) for t in terms]).match(q)
        assert got == (float(q in terms), float(any(len(t) >= 5 and near(q, t) for t in terms)))


def test_toxicity(spark, none):
    r, bad = random.Random(7), ["grubble", "snarkit"]
    vocab = ["".join(r.choice("abcdefg") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w, toxic = [r.choice(vocab) for _ in range(60)], i % 4 == 0
        for _ in range(4 if toxic else 0):
            w.insert(r.randrange(60), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, " ".join(vocab[:30]) + " " + "grubbel grubbl snarkit " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5001, None, None), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    held = [i for i in range(900) if remainder(i, 3) == 1]
    assert all(got[i].held_out for i in held) and sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[5002].predicted == 1 and got[5001].predicted == 0 and got[5000].score == got[5001].score
    assert toxicity.toxicity(none, marks).count() == 0
    alone = toxicity.toxicity(docs, marks.where("toxic = 0")).agg({"score": "max"}).first()[0]
    assert alone < 0.01


def shuffled_bytes(spark) -> int:
    sc, jvm = spark._jsc.sc(), spark._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_a_label_are_not_shuffled(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"{r.getrandbits(60):x}" for _ in range(400))) for i in [*range(0, 6000, 10), *range(1, 1000, 10), 20, 20, None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = common.shared_table(docs, "docs")
    labels = spark.createDataFrame([(i, 1, int(i % 20 == 0)) for i in range(0, 200, 10)], "doc_id long, quality int, toxic int")
    want = sorted((t, int(i % 20 == 0)) for i, t in rows if i is not None and i % 10 == 0 and i < 200 and remainder(i, 3) != 1)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with labels too large for it
    try:
        before = shuffled_bytes(spark)
        assert sorted(map(tuple, toxicity.training_rows(docs, labels).collect())) == want
        assert shuffled_bytes(spark) - before < sum(len(t) for _, t in rows) / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    ids = toxicity.marked_ids(labels)
    full = toxicity.likely_rows(docs, ids, most_bits=64).join(ids, "doc_id").select("text", "toxic")  # a bitmap too small drops little
    assert sorted(map(tuple, full.collect())) == want


def test_misspelt_terms_of_many_forms_and_of_four_letters(spark):
    r, forms = random.Random(8), ["idiot", "idiotic", "idiots", "idiotin", "idioten", "idiotka"]
    vocab = ["".join(r.choice("abcefg") for _ in range(7)) for _ in range(300)]
    rows = []
    for i in range(240):
        w = [r.choice(vocab) for _ in range(40)]
        for x in [*forms, "scum"] if i % 3 == 0 else []:
            w.insert(r.randrange(40), x)
        rows.append((" ".join(w), int(i % 3 == 0)))
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"idi", "idiot"} & {t for t, beginning, _ in terms if beginning}
    m = toxicity.Matcher(terms)
    for w in ("ldiotic", "1diots", "iddiot", "ldiot", "skum", "scumm", "scu", "xcum"):
        assert m.weights([w])[0][1] > 0, w
    assert m.weights(["idiotesque"])[0][0] > 0 and m.weights(["ldiotesque", "skumm"]) == [(0.0, 0.0)] * 2


def test_quotation_lowers_the_weight():
    m = toxicity.Matcher([("grubble", False, 5.0)])
    used, cited = m.features("you grubble you"), m.features('they said "grubble" once')
    assert used[0] > 0 and used[5] == 0 and cited[0] == 0 and cited[5] > 0
