"""Small tables with awkward rows, and plain versions of what the operators compute."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def duck(sf=DATA):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(spark):
    """Nulls, empty and blank texts, one long text, ties, repeated rows; and columns whose names operators use inside."""
    rng = random.Random(1)
    long = words_of(rng, 30_000, 10**6)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "One", None, "a", 3), (5, "one", "fr", "b", 3), (6, long, "en", "a", len(long)), (7, long.upper(), "en", "a", len(long)), (8, words_of(rng, 40), "de", "b", 9), (8, None, "de", "b", 9), (None, "no name", "de", "b", 7), (9, "Ünïcode wörds\nÜnïcode wörds\r\nzwölf", "de", "b", 9), (9, "Ünïcode wörds\nÜnïcode wörds\r\nzwölf", "de", "b", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(("score", "key", "block", "digest", "n_hit", "kept", "token", "_c0", "at", "node", "bin_id")):
        df = df.selectExpr("*", f"{i} as {name}")
    return df


def near_copies(rng, n=120):
    """Texts of which many are copies of others with some words changed, inserted or dropped."""
    base = [words_of(rng, rng.randrange(1, 120)) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(0, 2)] = [f"x{rng.randrange(50)}"]
        out.append(" ".join(words))
    return out


def family(rng, n, length=100):
    """Texts of one family: each has one to five words of a common text changed, so that many don't link with each other."""
    base, out = words_of(rng, length, 10**6).split(), []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(length), rng.randrange(1, 6)):
            words[at] = f"x{rng.randrange(50)}"
        out.append(" ".join(words))
    return out


def linked_components(texts):
    """As ``jaccard_components``, for texts that nearly all share shingles: all pairs by one product of matrices."""
    sets = [shingles(t) for t in texts]
    names = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, [names[g] for g in s]] = 1
    met, size = held @ held.T, held.sum(axis=1)
    linked = 100 * met >= 75 * (size[:, None] + size[None] - met)
    label = np.arange(len(sets))
    while True:
        new = np.where(linked, label[None], len(sets)).min(axis=1)
        if (new == label).all():
            return dict(enumerate(label.tolist()))
        label = new


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def jaccard_components(texts):
    """{id: smallest id linked}, by comparing all pairs that share a shingle."""
    sets, inverted, parent = {i: shingles(t) for i, t in texts.items()}, defaultdict(list), {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        met = Counter(j for g in s for j in inverted[g])
        for g in s:
            inverted[g].append(i)
        for j, k in met.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def cut_repeats(texts, length):
    """[(n_bytes, n_removed, n_spans, sha256)] by looking up every string of ``length`` bytes."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out
