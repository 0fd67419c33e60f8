"""The source audit against SQL and against all cells written out."""

import random
from collections import Counter, defaultdict

import pytest
from helpers import DATA, awkward, duck
from pyspark.sql import functions as F

from tickspark.llm import source_audit as audit


def written_out(rows, least, top):
    """The audit of (text, lang, source) rows, cell by cell."""
    rows = [((t or ""), lang or "", s or "") for t, lang, s in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), sorted({r[1:] for r in rows})
    for text, lang, source in rows:
        letters = "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in text)
        terms = [t for t in letters.split(" ") if t]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = lambda c: sum(c[t] for t in kept)
        share = lambda c, t: 1 + (10**9 * (c[t] + 5)) // (total(c) + 5 * len(kept))
        own, every = counts[lang, source], sum((counts[g] for g in groups if g[0] == lang), Counter())
        pairs = [(s, sum(abs(share(own, t) - share(counts[lang, s], t)) for t in kept)) for k, s in groups if k == lang and s != source]
        terms = [(t, share(own, t) - share(every, t)) for t in kept if own[t] and share(own, t) > share(every, t)]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(ranked[: top if part == "term" else None], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("sf", [DATA, DATA.replace("sf0.001", "sf0.01")])
def test_equals_sql(spark, sf):
    want = duck(sf).execute(f"SELECT lang, source, part, item, value, rank FROM ({audit.ORACLE['op12_source_audit']})").fetchall()
    assert got(audit.op12_source_audit(spark, sf)) == sorted(want) and len(want) > 500


@pytest.mark.parametrize("held", [3, 10**6])
def test_equals_all_cells_written_out(spark, held):
    rng = random.Random(held)
    word = lambda: "".join(rng.choice("abCé") for _ in range(rng.randrange(1, 4)))
    rows = [(rng.choice([None, "", "1 2"]) if rng.random() < 0.1 else "-".join(word() for _ in range(rng.randrange(1, 60))), rng.choice(["x", "y", None]), rng.choice(["s1", "s2", "é", None])) for _ in range(120)]
    rows += [("", "x", "silent"), (None, "lone", "one"), ("rare", "z", "p"), ("other", "z", "q")] + [rows[0]] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).withColumn("n", F.lit("clash")).withColumn("term", F.lit(1))
    found = got(audit.divergence(df, least_docs=4, top=7, held=held))
    assert found == written_out(rows, 4, 7)
    assert [r for r in found if r[0] == "z"] == [("z", "p", "pair", "q", 0, 1), ("z", "q", "pair", "p", 0, 1)]
    assert any(r[1] == "silent" and r[4] > 0 for r in found) and not any(r[0] == "lone" for r in found)


def test_joint_histograms_hold_every_kept_term_once(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["a", "b", "c", "d", "e"][: 2 + i % 4]) for _ in range(9)), "x", f"s{i % 4}") for i in range(24)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = audit.kept_cells(df, 1).cache()
    cells = audit.joint_histograms(kept, audit.group_totals(df, kept)).where("m <> 0").collect()
    sums = Counter()
    for r in cells:
        assert r.m > 0
        sums[r.a, r.b] += r.m
    v = kept.select("term").distinct().count()
    assert sums == {(f"s{i}", f"s{j}"): v for i in range(4) for j in range(i + 1, 4)}


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 10**17 + 3, 3 * 10**17 + 7, 5 * 10**6
    made = spark.range(1).select(audit.share(F.lit(n), F.lit(total), F.lit(v))).first()[0]
    assert made == 1 + (10**9 * (n + 5)) // (total + 5 * v)


def test_pieces_cut_no_term():
    text = "ab Cd" + "e" * 50 + " ff, gé"
    for piece in (1, 3, 7, 1000):
        assert [t for part in audit.term_lists(text, piece) for t in part] == ["ab".encode(), ("cd" + "e" * 50).encode(), b"ff", "gé".encode()]


def test_awkward_and_empty_tables(spark):
    df = awkward(spark)
    rows = [(r.text, r.lang, r.source) for r in df.collect()]
    assert got(audit.divergence(df, least_docs=2)) == written_out(rows, 2, 50)
    assert audit.divergence(df.limit(0)).count() == 0
