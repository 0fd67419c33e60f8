"""Classifiers by held-out accuracy, language-model scores and contamination against SQL, the pipeline from end to end."""

import random

import numpy as np
import pytest
from helpers import DATA, awkward, duck, words_of
from pyspark.sql import functions as F

from tickspark.llm import decontaminate, features, language, lm_score, quality, toxicity

LARGER = "/root/testdata/sf0.01"


def auc(y, p):
    rank = np.argsort(np.argsort(p))
    n1 = sum(y)
    return (sum(r for r, v in zip(rank, y, strict=True) if v) - n1 * (n1 - 1) / 2) / n1 / (len(y) - n1)


def labelled(spark, found, label, held):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label)
    rows = found.where(F.col("held_out") == held).join(labels, "doc_id").collect()
    return [r[label] for r in rows], [r.score for r in rows], [r.predicted for r in rows]


def test_quality_on_held_out_rows(spark):
    y, p, _ = labelled(spark, quality.op2_quality(spark, LARGER), "quality", True)
    assert auc(y, p) > 0.98


def test_toxicity(spark):
    found = toxicity.op10_toxicity(spark, LARGER)
    y, p, _ = labelled(spark, found, "toxic", True)
    assert auc(y, p) > 0.85  # a table this small has some forty confirmed texts


def test_toxicity_learns_from_enough_texts(spark):
    rng = random.Random(3)
    rows = [(i, words_of(rng, 60) + (f" vile{rng.choice('abc')}" if i % 8 == 0 else ""), "en", "s") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 2400, 2)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert np.mean([(scores[i] >= 0.3) == (i % 8 == 0) for i in range(2400)]) > 0.98


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = language.op1_language(spark, LARGER).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_language_is_learnt(spark):
    rng = random.Random(7)
    rows = []
    for k in range(70):  # the last ones are the rarest
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)]
        rows += [(f"l{k:02}", " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(12))) for _ in range(12 if k < 60 else 8)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    found = language.predict(docs, language.train(docs), keep=("doc_id", "lang")).collect()
    assert {r.lang_pred for r in found} == {r.lang for r in found}
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    named = docs.select("doc_id", F.col("lang").alias("known"))
    for total, least, each in ((210, 2, 3), (210, 5, 5), (None, 1, 6)):
        counts = [r["count"] for r in features.sampled(named, docs, "known", 6, total, least).groupBy("known").count().collect()]
        assert counts == [each] * 70


@pytest.mark.parametrize("n", [2, 3, 4, 9])
def test_codewords_lie_apart(n):
    words = language.codewords(n)
    apart = (words.shape[1] - words @ words.T) / 2
    assert words.shape[0] == n and (np.abs(words) == 1).all() and apart[~np.eye(n, dtype=bool)].min() >= max(1, words.shape[1] // 4)


def test_models_on_awkward_rows(spark):
    df = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (5, None, None), (6, 1, 1), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        for module in (quality, toxicity):
            rows = module.score(df, module.train(df, labels)).collect()
            assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
            assert module.score(df.limit(0), module.train(df.limit(0), labels)).count() == 0
    assert quality.keep_good(df, quality.train(df, none)).columns == df.columns
    rows = language.predict(df, language.train(df)).collect()
    assert len(rows) == df.count() and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.predict(df.limit(0), language.train(df.limit(0))).count() == 0
    assert {r.lang_pred for r in language.predict(df, language.train(df.limit(0))).collect()} == {"und"}


def test_distinct_features_are_all_features():
    rng = np.random.default_rng(1)
    scratch = np.zeros(1 << 10, np.int32)
    for n in (0, 1, 50, 5000):
        codes = rng.integers(0, 1 << 10, n).astype(np.uint32)
        assert sorted(features.distinct(codes, scratch)) == sorted(set(codes.tolist()))


def test_scores_equal_sql(spark):
    want = duck().execute(lm_score.ORACLE["op3_lm_score"]).fetchall()
    got = lm_score.op3_lm_score(spark, DATA).select("doc_id", "n_words", "log_prob", "mean_log_prob", "n_tri", "n_bi", "n_uni").collect()
    assert np.allclose(sorted(map(tuple, got)), sorted(want), atol=1e-3)


def test_scores_don_t_depend_on_blocks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, many = (sorted(map(tuple, lm_score.scores(docs, block_bytes=b).collect())) for b in (1 << 30, 20_000))
    assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in many]
    assert [r[2] for r in one] == pytest.approx([r[2] for r in many])


def test_n_grams_with_the_same_first_bits_are_told_apart(spark):
    names = [f"w{i}" for i in range(40_000)]
    data = np.frombuffer(" ".join(names).encode(), np.uint8)
    words, row = lm_score.word_hashes(data, np.array([0, len(data)]))
    keys = lm_score.grams(words, row, np.uint64(64 - 25))[1][0]  # more bits than such small texts once had
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(keys[order][1:] == keys[order][:-1])[0]
    pair = [(0, names[order[at]]), (1, names[order[at + 1]])]
    rows = lm_score.scores(spark.createDataFrame(pair, "doc_id long, text string")).collect()
    assert [r.log_prob for r in rows] == pytest.approx([np.log(0.5)] * 2)


def test_scores_of_awkward_rows(spark):
    df = awkward(spark)
    rows = lm_score.scores(df).collect()
    assert len(rows) == df.count() and all(r.log_prob == 0 for r in rows if not r.n_words)
    assert lm_score.scores(df.limit(0)).count() == 0


def test_contamination_equals_sql(spark):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = duck().execute(decontaminate.ORACLE["op8_decontaminate"]).fetchall()
    assert sorted(map(tuple, decontaminate.op8_decontaminate(spark, DATA).select(*columns).collect())) == sorted(want)


def test_many_automata_hit_what_one_hits(spark):
    docs, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many, turns = (sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in decontaminate.hits(docs, benchmark, max_pattern_bytes=m, group_bytes=g).collect()) for m, g in ((32 << 20, 1 << 20), (20_000, 64 << 20), (20_000, 50_000)))
    assert one == many == turns and sum(r[2] for r in one) > 0


def test_spans_point_into_the_original(spark):
    item = " ".join(f"q{i}" for i in range(15))
    text = "Ähm, " + item.replace(" ", " -- ").upper() + "! Ende"
    docs = spark.createDataFrame([(1, text), (2, item.rsplit(" ", 3)[0]), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "ende"), (9, None), (10, "...")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.hits(docs, items).collect()}
    assert [text.encode()[s.start : s.end].decode() for s in got[1].spans] == [item.replace(" ", " -- ").upper() + "! Ende"]
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (17, 16, ["7", "8"]) and got[2].n_hit == 0 and got[3].n_words == 0


def test_contamination_of_awkward_rows(spark):
    df = awkward(spark)
    items = spark.createDataFrame([(1, "one"), (None, None)], "item_id long, text string")
    kept = decontaminate.decontaminate(df, items)
    assert kept.columns == df.columns and {r.doc_id for r in df.collect()} - {r.doc_id for r in kept.collect()} == {4, 5}
    assert decontaminate.decontaminate(df, items.limit(0)).count() == df.count()
    assert decontaminate.decontaminate(df.limit(0), items).count() == 0


def test_pipeline_of_awkward_rows(spark, tmp_path):
    import shutil

    import corpus_pipeline

    for name in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path)
    rows = awkward(spark)
    common = spark.read.parquet(f"{DATA}/documents.parquet")
    rows.unionByName(common, allowMissingColumns=True).unionByName(common.limit(20), allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.count(), stage(spark, docs, str(tmp_path)).cache()
        if name == "packing":
            assert docs.count() >= before
        else:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS and docs.count() <= before
        if name == "exact_dedup":
            texts = [exact_dedup_key(r.text) for r in docs.collect()]
            assert len(texts) == len(set(texts))


def exact_dedup_key(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, LARGER).cache()
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] > 0
    assert corpus_pipeline.run(spark, LARGER).count() == counts[-1]
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0
