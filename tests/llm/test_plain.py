"""Packing, the models' decoding and fit, and the pipeline, against plain versions of what they compute."""

import struct

import numpy as np
import xxhash
from helpers import DATA, awkward, duck, jaccard_components
from pyspark.sql import functions as F

from tickspark.llm import decontaminate, language, packing, quality


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def dealt(ident, piece, shards):
    """Of a piece its shard: hashes with the seed that the one before left, as a signed number."""
    h = 42 if ident is None else xxhash.xxh64_intdigest(struct.pack("<q", ident), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", piece), h)
    return (h - (1 << 64) if h >> 63 else h) % shards


def packed(rows, capacity, shard_rows):
    """[(doc_id, piece, n_words, bin_id, start, residual)] for rows of (doc_id, text, source)."""
    most = sum(max(-(-(len((t or "").encode()) + 1) // (2 * capacity)), 1) for _, t, _ in rows)
    shards, pieces = max(1, -(-most // shard_rows)), []
    for ident, text, source in rows:
        n = len((text or "").encode().split())
        for piece in range(max(1, -(-n // capacity))):
            pieces.append((dealt(ident, piece, shards), ident, piece, min(n - piece * capacity, capacity), source, lowered(text)))
    out = []
    for shard in range(shards):
        bins = []
        own = sorted((p for p in pieces if p[0] == shard), key=lambda p: (-p[3], p[1], p[2]))
        placed = []
        for turn, (_, ident, piece, n, source, cluster) in enumerate(own):
            if not n:
                placed.append((ident, piece, n, None, None))
                continue
            # of equal rooms the one that came to it first
            fits = [(b["room"], b["turn"], i) for i, b in enumerate(bins) if b["room"] >= n and (source is None or source not in b["sources"]) and cluster not in b["clusters"]]
            if not fits:
                bins.append({"room": capacity, "sources": set(), "clusters": set()})
            at = min(fits)[2] if fits else len(bins) - 1
            b = bins[at]
            placed.append((ident, piece, n, at, capacity - b["room"]))
            b["room"], b["turn"] = b["room"] - n, turn
            b["sources"].add(source)
            b["clusters"].add(cluster)
        out += [(*p[:3], *((None, None, None) if p[3] is None else (shard << 32 | p[3], p[4], bins[p[3]]["room"]))) for p in placed]
    return out


def by_row(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_packing_equals_a_plain_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for capacity, shard_rows in ((2048, 16_384), (100, 64)):
        assert by_row(packing.pack(docs, capacity=capacity, shard_rows=shard_rows).collect()) == by_row(packed(rows, capacity, shard_rows))
    assert by_row(packing.op5_packing(spark, DATA).collect()) == by_row(packed(rows, 2048, 16_384))


def test_packing_of_awkward_rows_equals_a_plain_one(spark):
    docs = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert by_row(packing.pack(docs, capacity=500, shard_rows=30).collect()) == by_row(packed(rows, 500, 30))


def test_the_nearest_codeword_by_weighted_loss():
    rng = np.random.default_rng(3)
    for n in (2, 4, 9):
        words = language.codewords(n)
        trust = rng.uniform(0.1, 2, words.shape[1])
        model = language.Model([f"l{i}" for i in range(n)], words, None, None, trust)
        bits = rng.normal(0, 2, (40, words.shape[1]))
        best, score, lead = model.decode(bits)
        for row, b, s, gap in zip(bits, best, score, lead, strict=True):
            loss = [sum(t * np.log(1 + np.exp(-m * w)) for t, m, w in zip(trust, row, word, strict=True)) for word in words]
            first, second = sorted(loss)[:2]
            assert loss[b] == min(loss)
            assert np.isclose(s, 1 / sum(np.exp(first - x) for x in loss)) and np.isclose(gap, (second - first) / (second + first))


def test_ratios_and_dual_descent_reach_what_descent_on_the_weights_reaches():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, rng.integers(1, 12))) for _ in range(60)]
    positive = np.array([(r < 12).mean() + rng.normal(0, 0.2) > 0.4 for r in rows])
    scale = quality.log_count_ratios(rows, positive, 30)
    held = np.array([[g in r for g in range(30)] for r in rows], float)
    shares = [(1 + held[positive == y].sum(axis=0)) / (1 + held[positive == y].sum(axis=0)).sum() for y in (False, True)]
    assert np.allclose(scale, np.log(shares[1] / shares[0]), atol=1e-5)
    weights, bias = quality.dual_coordinate_descent(rows, positive, scale, epochs=5000)
    x = np.hstack([held * scale / np.sqrt(held.sum(axis=1, keepdims=True)), np.ones((60, 1))])
    y, w = np.where(positive, 1.0, -1.0), np.zeros(31)
    for _ in range(50):  # Newton steps on |w|^2 / 2 + the sum of squared hinges
        on = y * (x @ w) < 1
        w = np.linalg.solve(np.eye(31) + 2 * x[on].T @ x[on], 2 * x[on].T @ y[on])
    assert np.allclose([*weights, bias], w, atol=0.02) and np.abs(w).max() > 0.2


def test_the_pipeline_equals_its_plain_stages(spark):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    # the classifier is held to plain versions above: here its decisions are taken as they are
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).where(F.col("score") >= quality.THRESHOLD).collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    last = {}
    for ident in sorted(rows):
        last[lowered(rows[ident].text)] = ident
    rows = {i: rows[i] for i in last.values()}
    first = jaccard_components({i: r.text for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if first[i] == i}
    con = duck(DATA)
    con.execute("CREATE TABLE left_over (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO left_over VALUES (?, ?)", [(i, r.text) for i, r in rows.items()])
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM left_over")
    hit = con.sql(decontaminate.ORACLE["op8_decontaminate"]).df()
    bad = set(hit[hit.contaminated].doc_id)
    rows = [(i, r.text, r.source) for i, r in rows.items() if i not in bad]
    assert len(good) > len(last) > len(rows) > 0 and bad
    assert by_row(corpus_pipeline.run(spark, DATA).collect()) == by_row(packed(rows, 2048, 16_384))
