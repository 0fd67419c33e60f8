"""Stupid-backoff language-model scores from the corpus' own n-gram counts.

Counts of uni-, bi- and trigrams over all documents are tables partitioned by hash (packed exchange): each block of
documents, as they lie in a task, sends its distinct n-grams with their counts, the partition that owns an n-gram sums them, and the sums join
back to the block's n-grams, whose scores are summed per document. A trigram can be met ``at_least`` times only if both of its
bigrams are, so trigrams are counted in a second round, and those alone whose bigrams were met that often.

S(w | u v) = c(u v w) / c(u v) if the trigram was met ``at_least`` times, else alpha * S(w | v); S(w | v) = c(v w) / c(v) if
the bigram was, else alpha * c(w) / N. The first words of a text have no context and start at the lower order. With
at_least = 2 a text's own single n-grams don't count for themselves.

Words are what blanks separate, A-Z lower-cased; n-grams are counted by hashes of KEY_BITS bits at any size of the text: among
a billion distinct n-grams some 0.05 pairs are expected to meet by chance and then count together.

Edge cases: a null, empty or blank text has 0 words, log_prob 0 and no perplexity; repeated rows count each; a null
identifier is scored like any other; a very long text is hashed slice by slice, in a block of its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm import exchange
from tickspark.llm.text import LOWER, SHINGLE_WORD, bounded_batches, gram_hash, mix, prefix_hash, raw, slices, span_hash, text_bytes, word_spans

ALPHA = 0.4
AT_LEAST = 2
KEY_BITS = 63  # the widest that exchange takes
BLOCKS = "block int, ids array<long>, sizes array<long>, texts binary"
SCORES = "doc_id long, n_words long, log_prob double, n_tri long, n_bi long, n_uni long"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of a block."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, row = word_spans(part, offsets[lo : hi + 1] - offsets[lo], SHINGLE_WORD)
        hashes.append(span_hash(prefix_hash(part), starts, ends))
        rows.append(row + lo)
    return np.concatenate(hashes), np.concatenate(rows)


def grams(words: np.ndarray, row: np.ndarray, shift: np.uint64) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each order its n-grams (keys) and the place of each one's last word."""
    out = {}
    for order in (1, 2, 3):
        whole = np.flatnonzero(row[order - 1 :] == row[: len(row) - order + 1]) if len(row) >= order else np.zeros(0, np.int64)
        out[order] = (gram_hash(words, order)[whole] >> shift, whole + order - 1)
    return out


def packed_texts(docs: DataFrame, block_bytes: int) -> DataFrame:
    """BLOCKS: identifiers, lengths and compressed bytes of the texts of a task, in stretches of ``block_bytes`` (a longer text
    stands alone). A block's number is a mix of its task's and its own; two that meet by chance are taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size, made, task = [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            number = int(mix(np.array([task << 32 | made], np.uint64))[0] >> np.uint64(33))
            blob = zstandard.ZstdCompressor().compress(b"".join(parts))
            return pa.record_batch([pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["block", "ids", "sizes", "texts"])

        for b in batches:
            task = b.column("task")[0].as_py() if b.num_rows else task
            data, offsets = raw(b.column("text"))
            for i, ident in enumerate(b.column("doc_id").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                if parts and size + len(text) > block_bytes:
                    yield block()
                    ids, parts, size, made = [], [], 0, made + 1
                ids.append(ident)
                parts.append(text)
                size += len(text)
        if parts:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("task")).mapInArrow(run, BLOCKS)


def opened(table: pa.Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(identifiers, bytes, offsets) of the texts in rows of BLOCKS."""
    data = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table.column("texts").to_pylist())
    sizes = [n for row in table.column("sizes").to_pylist() for n in row]
    return [d for row in table.column("ids").to_pylist() for d in row], np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


def scores(docs: DataFrame, alpha: float = ALPHA, at_least: int = AT_LEAST, block_bytes: int = 4 << 20) -> DataFrame:
    """SCORES of every row: words, natural log of the summed scores, and how many words each order scored."""
    bounded_batches(docs.sparkSession)
    n_bytes = text_bytes(docs)
    _, buckets = exchange.block_counts(n_bytes, block_bytes)
    bits = KEY_BITS
    shift = np.uint64(64 - bits)
    texts = packed_texts(docs, block_bytes).groupBy("block")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        words, row = word_hashes(*opened(table)[1:])
        found = grams(words, row, shift)
        kinds = {order: np.unique(found[order][0], return_counts=True) for order in (1, 2)}
        kinds[0] = (np.zeros(1, np.uint64), np.array([len(words)]))  # all words, under one key
        return exchange.requests(key[0].as_py(), kinds, buckets, bits)

    shorter = exchange.totals(texts.applyInArrow(ask, exchange.REQUEST))

    def met(found: dict, told: pa.Table, order: int, n: int) -> np.ndarray:
        """The count of the n-gram that ends in each of n words, 0 if there is none."""
        out = np.zeros(n)
        keys, back = np.unique(found[order][0], return_inverse=True)
        out[found[order][1]] = exchange.answered(told, order, keys, buckets, bits)[back]
        return out

    def hopeful(found: dict, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams both of whose bigrams were met often enough, so that they may have been too."""
        keys, last = found[3]
        may = (bigrams[last] >= at_least) & (bigrams[last - 1] >= at_least)
        return keys[may], last[may]

    def ask_longer(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        words, row = word_hashes(*opened(table)[1:])
        found = grams(words, row, shift)
        keys, _ = hopeful(found, met(found, told, 2, len(words)))
        return exchange.requests(key[0].as_py(), {3: np.unique(keys, return_counts=True)}, buckets, bits)

    longer = exchange.totals(texts.cogroup(shorter.groupBy("block")).applyInArrow(ask_longer, exchange.REQUEST))

    def add(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        ids, data, offsets = opened(table)
        words, row = word_hashes(data, offsets)
        total = float(exchange.answered(told, 0, np.zeros(1, np.uint64), buckets, bits)[0])
        found = grams(words, row, shift)
        c = {order: met(found, told, order, len(words)) for order in (1, 2)}
        found[3] = hopeful(found, c[2])
        c[3] = met(found, told, 3, len(words))
        before = {order: np.concatenate([[0.0], c[order][:-1]]) if len(words) else c[order] for order in (1, 2)}
        tri, bi = c[3] >= at_least, c[2] >= at_least
        first = np.concatenate([[True], row[1:] != row[:-1]]) if len(words) else np.zeros(0, bool)
        second = np.concatenate([[False], first[:-1]]) & ~first if len(words) else first
        with np.errstate(divide="ignore", invalid="ignore"):
            low = np.where(bi, c[2] / before[1], np.where(first, 1.0, alpha) * c[1] / total)
            value = np.where(tri, c[3] / before[2], np.where(first | second, 1.0, alpha) * low)
        n = len(ids)
        many = lambda of: np.bincount(row[of], minlength=n)
        made = (np.bincount(row, minlength=n), np.bincount(row, np.log(value), n).astype(np.float64), many(tri), many(bi & ~tri), many(~bi & ~tri))
        return pa.table([pa.array(ids, pa.int64()), *(pa.array(m) for m in made)], ["doc_id", "n_words", "log_prob", "n_tri", "n_bi", "n_uni"])

    return texts.cogroup(shorter.unionByName(longer).groupBy("block")).applyInArrow(add, SCORES)


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    found = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_prob") / F.col("n_words"), 6))
    return found.select("doc_id", "n_words", F.round("log_prob", 3).alias("log_prob"), mean.alias("mean_log_prob"), "n_tri", "n_bi", "n_uni")


ORACLE = {
    "op3_lm_score": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d),
g AS (SELECT doc_id, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (SELECT doc_id, coalesce(c3.n, 0) >= 2 AS tri, coalesce(c2.n, 0) >= 2 AS bi,
    CASE WHEN c3.n >= 2 THEN c3.n / b2.n
      ELSE (CASE WHEN g.u IS NULL THEN 1.0 ELSE 0.4 END) * (CASE WHEN c2.n >= 2 THEN c2.n / b1.n ELSE (CASE WHEN g.v IS NULL THEN 1.0 ELSE 0.4 END) * (c1.n / (SELECT count(*) FROM g)) END) END AS p
  FROM g JOIN c1 ON c1.w = g.w LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w
    LEFT JOIN c1 b1 ON b1.w = g.v LEFT JOIN c2 b2 ON b2.v = g.u AND b2.w = g.v),
t AS (SELECT doc_id, count(*) AS n_words, sum(ln(p)) AS lp, count(*) FILTER (tri) AS n_tri, count(*) FILTER (bi AND NOT tri) AS n_bi, count(*) FILTER (NOT bi AND NOT tri) AS n_uni FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(lp, 0), 3) AS log_prob, round(lp / n_words, 6) AS mean_log_prob,
  coalesce(n_tri, 0) AS n_tri, coalesce(n_bi, 0) AS n_bi, coalesce(n_uni, 0) AS n_uni
FROM d LEFT JOIN t USING (doc_id)"""
}
