"""Ranked search against SQL and against every document scored for every query."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, awkward, duck

from tickspark.llm import ranked_search as ranked


def terms_of(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text or "").split(" ")


def all_scored(docs, queries, top):
    """{item: [(doc_id, score)]} of (doc_id, text) rows and {item: [text]}."""
    counts = [(d, Counter(t for t in terms_of(text) if t)) for d, text in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, texts in queries.items():
        asked = Counter(t for text in texts for t in terms_of(text) if t)
        found = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                found.append((d, score))
        ordered = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:top]
        if ordered:
            out[item] = ordered
    return out


def by_item(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.rank):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


@pytest.mark.parametrize("sf", [DATA, DATA.replace("sf0.001", "sf0.01")])
def test_equals_sql(spark, sf):
    got = ranked.op13_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score")
    want = duck(sf).execute(f"SELECT item_id, rank, doc_id, score FROM ({ranked.ORACLE['op13_ranked_search']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) >= 500


@pytest.mark.parametrize(("seed", "size", "block", "limit"), [(1, 600, 256, 8 << 20), (2, 4000, 2, 0), (3, 1 << 20, 3, 0)])
def test_equals_all_documents_scored(spark, monkeypatch, seed, size, block, limit):
    monkeypatch.setattr(ranked, "BROADCAST_BYTES", limit)
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 60}{rng.choice(['', 'é', 'A'])}"
    docs = [(rng.choice([None, *range(150)]), " ".join(word() for _ in range(rng.randrange(0, 30)))) for _ in range(200)]
    docs += [docs[0], docs[1], (7, None), (8, "?!"), (-5, docs[3][1]), (10**15, docs[3][1])]
    items = [(f"q{i % 9}", " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(12)] + [(None, "w1 W1é"), ("none", "zzz"), ("null", None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(4)
    got = by_item(ranked.search(ranked.index(frame(docs, "doc_id long, text string"), size).cache(), frame(items, "item_id string, text string"), top=6, block=block))
    queries = {}
    for item, text in items:
        queries.setdefault(item, []).append(text)
    assert got == all_scored(docs, queries, 6) and None in got


def test_walks_with_following_lists_equal_full_sums():
    rng = random.Random(5)
    for _ in range(200):
        n, top = rng.randrange(1, 60), rng.randrange(1, 8)
        lists, total = [], Counter()
        for _ in range(rng.randrange(1, 8)):
            at = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
            part, weight = [rng.randrange(0, 5) for _ in at], rng.randrange(1, 4)
            lists.append((ranked.Postings(np.array(at), np.array(part)), weight))
            for a, x in zip(at, part, strict=True):
                total[a] += weight * x
        want = sorted(((s, a) for a, s in total.items() if s), key=lambda x: (-x[0], x[1]))[:top]
        assert sorted(ranked.best_of(lists, top), key=lambda x: (-x[0], x[1])) == want


def test_numbers_as_bytes_come_back():
    rng = random.Random(6)
    values = np.array([0, 1, 127, 128, 2**14 - 1, 2**14, 2**62, *(rng.getrandbits(rng.randrange(1, 63)) for _ in range(500))], np.int64)
    data, ends = ranked.to_bytes(values)
    assert ranked.from_bytes(data.tobytes()).tolist() == values.tolist() and ends[-1] == len(data)
    assert len(ranked.from_bytes(b"")) == 0 and len(ranked.to_bytes(np.zeros(0, np.int64))[0]) == 0


def test_pieces_cut_no_term():
    text = "ab Cd9" + "e" * 50 + " ff, gé"
    for piece in (1, 3, 7, 1000):
        assert ranked.counted(text, piece) == {b"ab": 1, ("cd9" + "e" * 50).encode(): 1, b"ff": 1, "gé".encode(): 1}


def test_awkward_and_empty_tables(spark):
    df = awkward(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    items = [(1, "one"), (2, docs[5][1][:200]), (3, "name wörds"), (3, "Ünïcode")]
    queries = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 as rank", "2 as term")
    assert by_item(ranked.search(ranked.index(df, 1000).cache(), queries)) == all_scored(docs, {1: ["one"], 2: [items[1][1]], 3: ["name wörds", "Ünïcode"]}, 20)
    assert ranked.search(ranked.index(df.limit(0)), queries).count() == 0
    assert ranked.search(ranked.index(df), queries.limit(0)).count() == 0
