"""How the sources of each language diverge in the words they use, by joint count histograms.

1. Tasks count terms by language and source, in dictionaries of bounded size that are sent when full; one shuffle by
   language and term adds the counts up, and keeps the terms that enough documents of the language have. What follows works
   on one row for each source and kept term.
2. Two sources meet on their common terms, and only (count, count) combinations with their multiplicity leave the join.
   Cells with a zero on one side or both are implied: each source's own histogram of counts, and the number of kept terms,
   less what the common cells account for. One sum gives the whole joint histogram of a pair.
3. The function of the two shares is evaluated once for each combination and taken times its multiplicity.

Counts are whole numbers, shares are in units of 1 / SCALE rounded down, quotients are formed with decimals of 38 digits: all
of it is exact up to 10**18 occurrences. A pair is worked out once and listed for both of its sources. The pairs of a language
are as many as its result has rows; a term that k sources share makes k * (k - 1) / 2 rows within the join.

Edge cases: null text, language and source count as empty ones; a document without terms still makes its group, with no
counts; a language without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; repeated
rows are documents each; ties go by the item's bytes; a very long text is counted piece by piece; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.spill import cut
from tickspark.llm.text import LOWER, bounded_batches

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 10**9, 50
#: Distinct terms by language and source that a task holds before it sends them, and bytes of a text split at once.
HELD, PIECE = 200_000, 1 << 22
#: Parts into which the sources of a language are dealt where each meets all others.
SALTS = 16
#: Bytes of terms (ASCII letters, lower-cased, and all beyond ASCII); other bytes become a space.
TERM_BYTES = bytes(LOWER[c] if bytes([c]).isalpha() or c >= 0x80 else 32 for c in range(256))
CELLS = "lang string, source string, term string, n long, docs long"


def term_lists(text: str | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size; no term is cut."""
    data = (text or "").encode().translate(TERM_BYTES)
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + piece)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def tallies(docs: DataFrame, held: int = HELD) -> DataFrame:
    """CELLS: occurrences of terms, and documents that have them, by language and source; a cell may have several rows."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs_) in groups.items():
                n = len(counts)
                if n:
                    terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                    yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), terms, pa.array(list(counts.values()), pa.int64()), pa.array([docs_[t] for t in counts], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(*(b.column(c) for c in ("lang", "source", "text")), strict=True):
                counts, docs_ = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                seen: set[bytes] = set()
                size -= len(counts)
                for terms in term_lists(text.as_py()):
                    counts.update(terms)
                    seen.update(terms)
                docs_.update(seen)
                size += len(counts)
                if size > held:
                    yield from sent()
                    groups, size = {}, 0
        yield from sent()

    return _named(docs).mapInArrow(run, CELLS)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")


def kept_cells(docs: DataFrame, least_docs: int = LEAST_DOCS, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, lang_n, first): a row for each source and kept term that it has, with the language's count, and
    whether it is the first row of its term. The sums and both windows use the one shuffle by language and term."""
    dealt = tallies(docs, held).repartition("lang", "term")
    cells = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = cells.select("*", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("lang_n"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    return whole.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + the smoothed share of a count, in units of 1 / SCALE rounded down; null without kept terms."""
    over = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return 1 + F.call_function("div", over, F.nullif(under, F.lit(0).cast("decimal(20,0)")))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v): occurrences of kept terms in each group and language, and their number."""
    groups = _named(docs).select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    both = groups.join(own, ["lang", "source"], "left").na.fill(0, ["total", "firsts"])
    langs = both.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("v"))
    return both.join(langs, "lang").select("lang", "source", "total", "lang_total", "v")


def joint_histograms(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m): how many kept terms have the count ca in source a and cb in b, for all a < b of a language."""
    side = lambda x: kept.select("lang", "term", F.col("source").alias(x), F.col("n").alias(f"c{x}"))
    common = side("a").join(side("b"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "ca", "cb").agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")
    # a common cell counts in its own place, and must no more count where either side's histogram has put its terms
    cell = lambda ca, cb, m: F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m"))
    ca, cb, m = F.col("ca"), F.col("cb"), F.col("m")
    shared = common.select("lang", "a", "b", F.inline(F.array(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m))))
    left = totals.select("lang", F.col("source").alias("a"), "v", F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt"))
    right = totals.select("lang", F.col("source").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    pairs = left.join(right, ["lang", "salt"]).where("a < b").select("lang", "a", "b", "v")
    counts = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("h"))
    marginal = lambda x, c: pairs.join(counts.select("lang", F.col("source").alias(x), F.col("n").alias(c), "h"), ["lang", x])
    h = F.col("h")
    alone = marginal("a", "ca").select("lang", "a", "b", F.inline(F.array(cell(ca, zero, h), cell(zero, zero, -h))))
    alone = alone.unionByName(marginal("b", "cb").select("lang", "a", "b", F.inline(F.array(cell(zero, cb, h), cell(zero, zero, -h)))))
    every = shared.unionByName(alone).unionByName(pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), F.col("v").alias("m")))
    return every.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def pair_values(kept: DataFrame, totals: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources, in both directions; f must be symmetric."""
    named = lambda x: totals.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), *(("v",) if x == "a" else ()))
    cells = joint_histograms(kept, totals).join(named("a"), ["lang", "a"]).join(named("b"), ["lang", "b"])
    value = f(share(F.col("ca"), F.col("total_a"), F.col("v")), share(F.col("cb"), F.col("total_b"), F.col("v")))
    sums = cells.groupBy("lang", "a", "b").agg(F.coalesce(F.sum(F.when(F.col("m") != 0, F.col("m") * value)), F.lit(0)).cast("long").alias("value"))
    turned = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", "value", F.inline(turned))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, f: Callable[[Column, Column], Column] = lambda p, q: F.abs(p - q), held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank) for each language and source: under ``pair`` its distance to each other source
    of the language, all of them ranked; under ``term`` the ``top`` terms it uses more than its language does."""
    kept = cut(kept_cells(docs, least_docs, held))
    totals = cut(group_totals(docs, kept))
    pairs = pair_values(kept, totals, f).withColumn("part", F.lit("pair"))
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = kept.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", f(F.col("p"), F.col("q")).cast("long").alias("value"), F.lit("term").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    fields = ("lang", "source", "part", "item", "value", place)
    return pairs.select(*fields).unionByName(terms.select(*fields).where(F.col("rank") <= top))


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op12_source_audit": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT lang, source, k, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
y AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total FROM x JOIN v USING (lang)),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM y),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e) WHERE part = 'pair' OR rank <= 50"""
}
