"""Tables, partitions and blocks that hold nothing but null, empty or blank texts, or nothing but copies; long texts."""

import random

import pytest
from helpers import words_of
from pyspark.sql import functions as F

from tickspark.llm import decontaminate, exact_dedup, language, line_dedup, lm_score, ngram_join, packing, quality, ranked_search, secret_scan, source_audit, suffix_dedup, text, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = [None, "", " \n\t "]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)], SCHEMA)


def applied(spark, docs):
    """Each operator's result over ``docs``."""
    bench = spark.createDataFrame([(1, words_of(random.Random(1), 20))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    yield "language", language.predict(docs, language.train(docs))
    yield "quality", quality.score(docs, quality.train(docs, labels))
    yield "lm_score", lm_score.scores(docs)
    yield "ngram_join", ngram_join.near_duplicates(docs)
    yield "exact_dedup", exact_dedup.exact_groups(docs, smallest=False)
    yield "decontaminate", decontaminate.hits(docs, bench)
    yield "suffix_dedup", suffix_dedup.repeats(docs)
    yield "line_dedup", line_dedup.dedup_lines(docs)
    yield "toxicity", toxicity.score(docs, toxicity.train(docs, labels))
    yield "secret_scan", secret_scan.findings(docs)


@pytest.mark.parametrize("value", BLANK)
def test_tables_of_one_row_without_words(spark, value):
    docs = docs_of(spark, [value])
    for name, out in applied(spark, docs):
        assert out.count() == 1, name
    assert packing.pack(docs).count() <= 1
    assert source_audit.divergence(docs).count() == 0
    assert ranked_search.search(ranked_search.index(docs), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_partitions_and_blocks_without_words(spark):
    rng = random.Random(2)
    texts = [words_of(rng, 40) for _ in range(4)] + BLANK * 4
    docs = docs_of(spark, texts).repartitionByRange(4, "doc_id")
    blank = [i for i, t in enumerate(texts) if not (t or "").split()]
    scores = {r.doc_id: r for r in lm_score.scores(docs, block_bytes=8).collect()}
    assert len(scores) == len(texts) and all(scores[i].n_words == 0 and scores[i].log_prob == 0 for i in blank)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, block_bytes=8).collect()}
    assert all(found[i] == (0, i) for i in blank) and all(found[i] == (36, i) for i in range(4))


def test_blocks_of_copies_only(spark):
    rng = random.Random(3)
    one, other = words_of(rng, 50), words_of(rng, 50)
    docs = docs_of(spark, [one] * 6 + [other])
    for size in (100, 4 << 20):
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, block_bytes=size).collect()}
        assert got == dict.fromkeys(range(6), 0) | {6: 6}
    long = words_of(rng, 700_000, 10**6)  # some 5 MB, more than a block
    got = ngram_join.near_duplicates(docs_of(spark, [long] * 4 + [None])).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4} and max(r.n_shingles for r in got) > 600_000


def test_long_texts_next_to_nulls(spark):
    rng = random.Random(4)
    long = [words_of(rng, 200_000, 5000) for _ in range(2)]  # each above a slice of text
    docs = docs_of(spark, [*long, "short text", None]).repartitionByRange(4, "doc_id")
    scores = {r.doc_id: r for r in lm_score.scores(docs).collect()}
    assert [scores[i].n_words for i in range(4)] == [200_000, 200_000, 2, 0]
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {i: i for i in range(4)}
    found = ranked_search.search(ranked_search.index(docs, 1000), spark.createDataFrame([(1, "Short w7")], "item_id long, text string"))
    assert [r.doc_id for r in found.orderBy("rank").collect()][0] == 2 and found.count() == 3


def test_a_fresh_worker_hashes_nothing(monkeypatch):
    monkeypatch.setattr(text, "_tables", {})
    assert [len(x) for x in text._powers(0)] == [0, 0]


def test_kept_columns_may_be_named_as_results_are(spark):
    docs = docs_of(spark, ["some text here", None]).withColumns({"lettered": F.lit(7), "score": F.lit(8), "lang_pred": F.lit(9)})
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert [r[:2] for r in language.predict(docs, language.train(docs), keep=("doc_id", "lettered", "score", "lang_pred")).collect()] == [(0, 7), (1, 7)]
    assert [r[:2] for r in quality.score(docs, quality.train(docs, labels), keep=("doc_id", "score")).collect()] == [(0, 8), (1, 8)]


def test_the_least_identifier_is_kept_too(spark):
    least = -(2**63)
    docs = spark.createDataFrame([(least, "a"), (least + 1, "A"), (2**63 - 1, "b"), (least, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(docs, smallest=False).collect()}
    assert got == {(least, least + 1, False), (least + 1, least + 1, True), (2**63 - 1, 2**63 - 1, True), (least, 2**63 - 1, False)}
