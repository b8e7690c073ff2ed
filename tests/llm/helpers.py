"""Small inputs with every awkward case, and brute-force versions of the operators."""

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, q string, h128 string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def remainder(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def texts(seed=1, n=120):
    """Rows of documents with copies, near copies, shared passages, nulls, blanks and a very long text; extra columns have clashing names."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(160))
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and out:
            t = r.choice(out)
        elif kind < 0.35 and out:
            w = (r.choice(out) or "x").split(" ")
            for _ in range(r.randrange(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif kind < 0.5:
            t = " ".join(r.choice(vocab) for _ in range(r.randrange(0, 30))) + "\n" + passage + "\n" + " ".join(r.choice(vocab) for _ in range(r.randrange(0, 30)))
        else:
            t = "".join(r.choice(vocab).title() + r.choice([" ", " ", "\n", ". "]) for _ in range(r.randrange(0, 120)))
        out.append(t)
    out += [None, None, "", " \n\t", "a", "A", "a b c", "x" * 5000, "ab " * 4000, "\x1c!\x85 Σ ΑΣ é", "<|endoftext|> a"]
    return [(i * 7 % 1000, t, "en" if i % 3 else None, None if i % 9 == 0 else f"s{min(i % 5, 2)}", None, 5, "q", "h") for i, t in enumerate(out)]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    return df.repartition(3) if rows else df
