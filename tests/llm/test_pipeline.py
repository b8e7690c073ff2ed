"""The pipeline's stages, one after another, against brute force."""

import collections
import hashlib

import numpy as np
from helpers import WORD, frame, lower, texts

import corpus_pipeline
from netloom.llm import common, quality


def test_stages(spark, tmp_path):
    rows = texts(seed=3, n=160)
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.shared_table(stage(spark, docs, str(tmp_path)), "stage")
        after[name] = docs
        if name != "bpe":
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    by_id = {r[0]: r[1] for r in rows}
    kept = {r.doc_id for r in quality.quality_report(frame(spark, rows)).where("kept").select("doc_id").collect()}
    assert ids(after["quality rules"]) == sorted(kept)
    first = {}
    for i in sorted(kept):
        first.setdefault(lower(by_id[i]), i)
    assert ids(after["exact dedup"]) == sorted(first.values())
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i in first.values() if (w := WORD.findall(lower(by_id[i])))}
    parent = {i: i for i in first.values()}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    near = sorted(i for i in parent if find(i) == i)
    assert ids(after["near dedup"]) == near
    size = {i: len(WORD.findall(by_id[i])) for i in near}
    taken = collections.Counter()
    for r in after["mixing"].collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert all(taken[i] <= 2 * size[i] for i in taken) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 5
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = lambda t: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in after["bpe"].collect()) == sorted((r.doc_id, digest(r.text)) for r in after["mixing"].collect())
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, after["bpe"].collect()))
