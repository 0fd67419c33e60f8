"""Exact, near and line copies, repeated strings and packing against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, awkward, cut_repeats, duck, family, jaccard_components, linked_components, near_copies, words_of
from pyspark.sql import functions as F

from tickspark.llm import components, exact_dedup, line_dedup, ngram_join, packing, suffix_dedup


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_exact_groups_equal_sql(spark):
    got = exact_dedup.op6_exact_dedup(spark, DATA).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = duck().execute(exact_dedup.ORACLE["op6_exact_dedup"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_equal_digests_of_unequal_texts_are_told_apart(spark):
    texts = [f"t{i % 30}" for i in range(60)]
    short = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2))
    found = exact_dedup.exact_groups(docs_of(spark, texts), digest=short, filter_bits=12).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == {(i, i % 30, 2) for i in range(60)}


@pytest.mark.parametrize("runs", [1, 2, 3, 8])
def test_runs_are_compacted_level_by_level(spark, runs):
    rng = random.Random(runs)
    rows = [(rng.randrange(runs), rng.randrange(400), i) for i in range(3000)]
    memtables = spark.createDataFrame(rows, "run int, x int, id long").select("run", F.unhex(F.sha2(F.col("x").cast("string"), 256)).alias("digest"), "id")
    level = exact_dedup.flush(memtables)
    assert level.count() == len({r[:2] for r in rows})
    for bits in (6, 20):  # filters that hold nearly everything, and that tell most digests apart
        got = {(bytes(r.digest), r.id, r.n) for r in exact_dedup.compact(level, runs, bits).collect()}
        want = {}
        for _, x, i in rows:
            low, n = want.get(x, (i, 0))
            want[x] = (min(low, i), n + 1)
        assert got == {(hashlib.sha256(str(x).encode()).digest(), *v) for x, v in want.items()}


def test_exact_dedup_of_awkward_rows(spark):
    df = awkward(spark)
    rows = exact_dedup.exact_groups(df).collect()
    assert len(rows) == df.count()
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    empty = [r for r in rows if r.keep_id == 1]
    assert {r.doc_id for r in empty} == {1, 2, 8} and all(r.group_size == 3 for r in empty)
    assert {r.keep_id for r in rows if r.doc_id in (4, 5)} == {4} and {r.keep_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert len(by) == len(rows) - 1  # the repeated row
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_exact_dedup_keeps_rows_not_identifiers(spark):
    rows = [(5, "x"), (9, "X"), (5, "y"), (7, "z"), (7, "z"), (None, "z"), (None, "w"), (None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept_id", F.lit(1))
    for smallest, want in ((True, [(5, "x"), (5, "y"), (7, "z"), (None, "w")]), (False, [(9, "X"), (5, "y"), (7, "z"), (None, "w")])):
        found = exact_dedup.exact_dedup(df, smallest=smallest)
        assert found.columns == df.columns
        assert sorted(map(str, ((r.doc_id, r.text) for r in found.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_equal_all_pairs(spark, seed):
    texts = near_copies(random.Random(seed), 160)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == jaccard_components(dict(enumerate(texts)))


def test_near_copies_over_many_blocks(spark):
    texts = near_copies(random.Random(9), 300)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs_of(spark, texts), block_bytes=2000).collect()}
    assert got == jaccard_components(dict(enumerate(texts)))


def test_pairs_of_a_family_of_which_many_do_not_link_stay_in_proportion(spark, monkeypatch):
    rng, tried, crossed = random.Random(7), [], ngram_join._crossed

    def counted(prefixes):
        found = crossed(prefixes)
        tried.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_crossed", counted)
    for n in (250, 500, 1000):
        texts = family(rng, n)
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
        want = linked_components(texts)
        assert got == want
        assert 0.3 * n < sum(v == 1 for v in Counter(want.values()).values()) < 0.9 * n
    print("pairs from the crossing of 250, 500 and 1000 texts:", tried)
    assert all(k <= 5 * n for k, n in zip(tried, (250, 500, 1000), strict=True))


def test_near_copies_of_awkward_rows(spark):
    df = awkward(spark)
    rows = ngram_join.near_duplicates(df).collect()
    assert len(rows) == df.count()
    got = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[3, 0] == 3  # empty sets link with nothing
    assert got[4, 1] == got[5, 1] == 4 and got[6, 29996] == got[7, 29996] == 6
    assert ngram_join.near_dedup(df).columns == df.columns
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_lines(spark):
    rng = random.Random(4)
    common, near = words_of(rng, 12, 9000), words_of(rng, 30, 9000)
    changed = near.rsplit(" ", 1)[0] + " other"
    texts = [f"{words_of(rng, 15, 9000)}\n{common}\n\n{near if i % 2 else changed}\n{common.upper()}" for i in range(8)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got[0].text == "\n".join(texts[0].split("\n")[:4]) and got[0].n_dropped == 1
    for i in range(1, 8):
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (5, 3, texts[i].split("\n")[0] + "\n")


def test_line_recall_and_awkward_rows(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(150):
        words = words_of(rng, 40, 10**6).split()
        other = list(words)
        other[rng.randrange(40)] = "changed"
        pairs += [" ".join(words), " ".join(other)]
    found = line_dedup.dedup_lines(docs_of(spark, pairs))
    assert found.agg(F.sum("n_dropped")).first()[0] >= 0.95 * 150
    df = awkward(spark)
    rows = line_dedup.dedup_lines(df).collect()
    assert len(rows) == df.count()
    assert {(r.n_lines, r.n_dropped, r.text) for r in rows if r.doc_id == 9} <= {(3, n, t) for n, t in ((0, "Ünïcode wörds\nÜnïcode wörds\r\nzwölf"), (1, "Ünïcode wörds\nzwölf"))}
    assert {r.text for r in rows if r.doc_id in (1, 2)} == {""}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_that_differ_behind_the_ninth_character_of_a_word(spark):
    rng = random.Random(3)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(n))
    urls = [f"https://en.wikipedia.org/wiki/{letters(60)}" for _ in range(12)]
    late = [" ".join(f"unchanged{w}{letters(20)}" for w in "abcd") for _ in range(12)]
    chinese = ["今天天气很好我们一起去" + letters(40, "的一是在不了有和人这中大为上个国我以要他") for _ in range(12)]
    different = [*urls, *late, *chinese]
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs_of(spark, different)).collect()} == {0}
    copies = [t[:-1] + "!" for t in different]
    found = line_dedup.dedup_lines(docs_of(spark, different + copies)).collect()
    assert {r.doc_id for r in found if r.n_dropped} == set(range(36, 72))


def test_lines_against_all_pairs(spark):
    rng = random.Random(11)
    kinds = ["abcdefghijklmnopqrstuvwxyz    ", "的一是在不了有和人这中大为上个国我以要他时来用们", "abcdefghijklmnopqrstuvwxyz0123456789/-", "abcdefghijklmnopqrstuvwxyz"]
    lines = []
    for k in range(80):
        own = kinds[k % 4]
        base = ["https://example.org/" if k % 4 == 2 else ""] + [rng.choice(own) for _ in range(rng.randrange(20, 160))]
        for _ in range(4):
            made = list(base)
            for _ in range(rng.randrange(0, 5)):
                made[rng.randrange(1, len(made))] = rng.choice(own)
            lines.append("".join(made).strip())
    width = line_dedup.SHINGLE
    sets = [frozenset(x[i : i + width] for i in range(max(1, len(x) - width + 1))) for x in lines]
    label = list(range(len(lines)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    want = {i for i in range(len(lines)) if root(i) != i}
    found = {r.doc_id for r in line_dedup.dedup_lines(docs_of(spark, lines)).collect() if r.n_dropped}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) > 60


def test_near_copies_of_lines_beside_their_buckets_leaders(spark):
    rng = random.Random(5)
    texts, template = [], "this half of the line is what a template prints into every line of the table:"
    for _ in range(150):  # unlike lines fill the buckets
        own = words_of(rng, 14, 10**6)
        texts += [f"{template} {own}", f"{template} {own[:-1]}!"]
    found = line_dedup.dedup_lines(docs_of(spark, texts)).collect()
    assert {r.doc_id for r in found if r.n_dropped} == set(range(1, 300, 2))


def test_only_similar_lines_come_out_of_the_crossing(spark, monkeypatch):
    rng, pairs, crossed = random.Random(6), [], line_dedup.crossed
    template, letters = "this half of the line is what a template prints into every line of the table:", "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for _ in range(80):  # unlike lines of a similarity of some 0.66
        own = "".join(rng.choice(letters) for _ in range(18))
        texts += [f"{template} {own}", f"{template} {own[:-1]}!"]

    def counted(*args):
        found = crossed(*args)
        pairs.extend(tuple(r) for r in found.collect())
        return found

    monkeypatch.setattr(line_dedup, "crossed", counted)
    found = line_dedup.dedup_lines(docs_of(spark, texts)).collect()
    assert {r.doc_id for r in found if r.n_dropped} == set(range(1, 160, 2))
    sets = {r.key: frozenset(r.norm[i : i + line_dedup.SHINGLE] for i in range(len(r.norm) - line_dedup.SHINGLE + 1)) for r in line_dedup.lines(docs_of(spark, texts)).collect()}
    assert len(set(pairs)) == len(pairs)
    assert all(4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) for a, b in pairs)


def test_bitmaps_are_made_of_lines_of_crossing_buckets_only(spark, monkeypatch):
    drawn, bitmaps, rng = [], line_dedup.bitmaps, random.Random(8)

    def counted(texts):
        drawn.extend(r.norm for r in texts.collect())
        return bitmaps(texts)

    monkeypatch.setattr(line_dedup, "bitmaps", counted)
    lines = [words_of(rng, 20, 10**6) for _ in range(20)]  # copies that their buckets' leaders join
    template = "this half of the line is what a template prints into every line of the table:"
    unlike = [f"{template} {own}{end}" for own in (words_of(rng, 14, 10**6) for _ in range(30)) for end in ".!"]
    found = line_dedup.dedup_lines(docs_of(spark, [line + end for line in lines for end in ".!"] + unlike)).collect()
    assert sum(r.n_dropped for r in found) == 20 + 30
    assert drawn and all(d.startswith(template) for d in drawn)


@pytest.mark.parametrize("salted", [1024, 3])
def test_every_pair_of_a_bucket_is_led_joined_or_crossed(spark, monkeypatch, salted):
    monkeypatch.setattr(line_dedup, "SALTED", salted)
    rows = [(b, k, low, high) for b, low, high in ((8, 1, 40), (16, 50, 60)) for k in range(low, high + 1)]
    met = spark.createDataFrame(rows, "bucket long, key long, low long, high long")
    labels = spark.createDataFrame([(k, 2 if k < 9 else 9) for k in range(2, 12)], "node long, component long")
    # lines of a long and of a short kind, whose minima differ in every byte
    words = ", ".join(f"s{i} long" for i in range(5))
    signed = spark.createDataFrame([(k, 100, 0, 0, *[0x010101010101 if k % 5 else 0x020202020202] * 5) for k in range(61)], f"key long, size int, held0 long, held1 long, {words}")
    label = lambda k: (2 if k < 9 else 9) if 2 <= k < 12 else k
    want = {(a, b) for low, high in ((2, 39), (51, 59)) for b in range(low, high + 1) for a in range(low, b) if label(a) != label(b) and bool(a % 5) == bool(b % 5)}
    found = [tuple(r) for r in line_dedup.crossed(met, labels, signed).collect()]
    assert set(found) == want and len(found) == len(want)


def test_signatures_are_made_by_a_method_that_gets_compiled(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        line_dedup.signatures(line_dedup.lines(docs_of(spark, ["one line"])), line_dedup.BANDS).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM only interprets longer ones


def test_bands_have_a_high_recall_at_the_threshold(spark):
    similarity = line_dedup.OVER / line_dedup.UNDER
    assert 1 - (1 - similarity**line_dedup.ROWS) ** line_dedup.BANDS >= 0.993
    # bands don't share buckets, however many there are
    signed = line_dedup.signatures(line_dedup.lines(docs_of(spark, ["one line", "One line ", "another one"])), line_dedup.BANDS)
    met = line_dedup.members(signed.unionByName(signed.withColumn("key", -F.col("key"))), 12)
    assert met.select("bucket", "key").distinct().count() == met.count() == 2 * 2 * line_dedup.BANDS
    assert met.select(F.col("bucket").bitwiseAND(F.lit(15).cast("long"))).distinct().count() == line_dedup.BANDS


def repeating_texts(seed):
    rng = random.Random(seed)
    shared = [words_of(rng, 30, 10**6) for _ in range(3)]
    texts = []
    for _ in range(40):
        parts = [words_of(rng, rng.randrange(0, 40), 10**6) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(shared)[rng.randrange(30) :])
        if rng.random() < 0.2:
            parts.append("ab ab " * rng.randrange(1, 80))
        texts.append(" ".join(parts))
    return [*texts, texts[0], "", None, "é" * 90]


@pytest.mark.parametrize(("seed", "hot"), [(1, 8192), (2, 8192), (3, 2)])
def test_repeated_strings_equal_a_lookup(spark, seed, hot):
    texts = repeating_texts(seed)
    df = docs_of(spark, texts)
    found = suffix_dedup.repeats(df, length=60, gram=16, block_bytes=3000, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == dict(enumerate(cut_repeats(texts, 60)))


def test_a_passage_in_twenty_thousand_places_equals_a_lookup(spark):
    rng = random.Random(8)
    passage = words_of(rng, 12, 10**6)
    texts = [f"{rng.randrange(10**9)} {passage} {rng.randrange(10**9)}" for _ in range(20_000)]
    for i in range(0, 20_000, 5000):  # a few go on alike beyond the passage
        texts[i] = f"{passage} and the same words behind it"
    df = docs_of(spark, texts)
    found = suffix_dedup.repeats(df, length=60, gram=16, block_bytes=300_000).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == dict(enumerate(cut_repeats(texts, 60)))


@pytest.mark.parametrize(("n", "goes"), [(300, 0), (399, 0), (400, 400), (800, 800)])
def test_planted_passages_of_so_many_bytes(spark, n, goes):
    rng = random.Random(n)
    passage = words_of(rng, 400, 10**6)[:n]
    texts = [f"{words_of(rng, 60, 10**9)}{end}{passage}{end}{words_of(rng, 60, 10**9)}" for end in "<>[]|"]
    assert {r.n_removed for r in suffix_dedup.repeats(docs_of(spark, texts)).collect()} == {goes}


@pytest.mark.parametrize(("n", "found"), [(50, 0), (51, 51), (60, 60)])
def test_passages_of_over_fifty_words_are_found_in_other_documents(spark, n, found):
    rng = random.Random(n)
    passage = words_of(rng, n, 10**4)
    assert len(passage) < suffix_dedup.LENGTH
    texts = [f"{words_of(rng, 60, 10**9)}\n{passage} {words_of(rng, 60, 10**9)}" for _ in range(3)]
    own = words_of(rng, n, 10**4)
    texts += [f"{own} between {own}", None, ""]  # within one document only
    rows = {r.doc_id: r for r in suffix_dedup.repeats(docs_of(spark, texts), block_bytes=700).collect()}
    assert [rows[i].n_passage_words for i in range(6)] == [found] * 3 + [0] * 3
    assert {r.n_removed for r in rows.values()} == {0}


def test_passages_equal_a_lookup_of_every_51_words(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode()) for r in rows]
    holders = {}
    for k, w in enumerate(words):
        for i in range(len(w) - 50):
            holders.setdefault(tuple(w[i : i + 51]), set()).add(k)
    want = {}
    for r, w in zip(rows, words, strict=True):
        want[r.doc_id] = len({j for i in range(len(w) - 50) if len(holders[tuple(w[i : i + 51])]) > 1 for j in range(i, i + 51)})
    found = {r.doc_id: r.n_passage_words for r in suffix_dedup.op9_suffix_dedup(spark, DATA).collect()}
    assert found == want and any(want.values())


def test_query_equals_a_lookup_of_every_400_bytes(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip((r.doc_id for r in rows), cut_repeats([r.text for r in rows], 400), strict=True))
    found = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.op9_suffix_dedup(spark, DATA).collect()}
    assert found == want and any(v[1] for v in want.values())


def test_deep_shallow_order_is_sorted():
    rng = np.random.default_rng(5)
    texts = rng.integers(1, 3, (300, 48), dtype=np.uint8)
    texts[100:200] = texts[:100]
    texts[150:200, 40:] = rng.integers(1, 3, (50, 8))
    group = rng.integers(0, 4, 300)
    order, common = suffix_dedup.deep_shallow(group, texts, 2)
    keys = [(group[i], texts[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for a, b, c in zip(order, order[1:], common[1:], strict=False):
        same = next((k for k in range(48) if texts[a][k] != texts[b][k]), 48)
        assert c == (same if group[a] == group[b] else -1)


def test_repeated_strings_of_awkward_rows(spark):
    df = awkward(spark)
    rows = suffix_dedup.repeats(df).collect()
    assert len(rows) == df.count() and {r.n_removed for r in rows} == {0}
    assert suffix_dedup.repeats(df.limit(0)).count() == 0


def test_bins_are_the_tightest():
    rng = random.Random(6)
    sizes = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
    sources, clusters = [rng.choice("aaabcde") for _ in sizes], [rng.choice([None, *range(80)]) for _ in sizes]
    own, start, _ = packing.pack_shard(np.array(sizes), [sources, clusters], 100)
    bins: list[dict] = []
    for k, size in enumerate(sizes):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and sources[k] not in b["s"] and (clusters[k] is None or clusters[k] not in b["c"])]
        if fits:
            assert bins[own[k]]["room"] == min(fits)[0] and (bins[own[k]]["room"], own[k]) in fits
        else:
            assert own[k] == len(bins)
            bins.append({"room": 100, "s": set(), "c": set()})
        b = bins[own[k]]
        assert start[k] == 100 - b["room"]
        b["room"] -= size
        b["s"].add(sources[k])
        b["c"].add(clusters[k])


def test_packing_keeps_every_word(spark):
    df = awkward(spark)
    rows = packing.pack(df, capacity=1000).collect()
    assert sum(r.n_words for r in rows if r.doc_id == 6) == 30_000
    assert all((r.bin_id is None) == (r.n_words == 0) for r in rows)
    used = {}
    for r in sorted((r for r in rows if r.bin_id is not None), key=lambda r: (r.bin_id, r.start)):
        assert used.get(r.bin_id, 0) == r.start
        used[r.bin_id] = r.start + r.n_words
    assert max(used.values()) <= 1000
    assert packing.pack(df.limit(0)).count() == 0
