"""Exact deduplication by a log-structured merge index, in DataFrame and SQL functions only.

A row's digest goes to one of ``runs`` memtables; each is flushed as a run of distinct digests, sorted, with its smallest
identifier, its count and a bitmap filter (one bit for a digest). Compaction joins two runs to one at each level, until one
is left: a digest meets the neighbouring run only if that run's filter may hold it, rows of both are walked in order of digest
and identifier, and the smallest identifier stays; all other digests pass as they are. Digests with more than one row are
hits: their texts are compared byte by byte (smallest against largest text of a digest, pre-aggregated before the shuffle). If
texts differ under one digest, the texts themselves take its place as key.

Edge cases: a null text counts as empty; rows with empty texts are one group; a null identifier is never kept in favour
of another one, but counts; rows that repeat identifier and text count each and share the decision; an empty table gives
no rows; a very long text is digested whole and compared only with texts of its digest; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.spill import cut
from tickspark.llm.text import given_back, set_aside

#: The letters that normalisation touches.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a digest above this part of all rows make it hot; there can be no more than this many hot digests.
HOT_PART = 1000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; a null gives the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def filter_position(digest: Column, bits: int) -> Column:
    """The bit of a filter of 2**bits bits that stands for a digest."""
    return F.pmod(F.xxhash64(digest), F.lit(1 << bits))


def filter_word(position: Column) -> Column:
    """The 64-bit word of a filter that holds a bit."""
    return F.shiftright(position, 6)


def has_bit(word: Column, position: Column) -> Column:
    shifted = F.call_function("shiftright", word, position.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.coalesce(shifted.bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))


def filters(digests: DataFrame, bits: int) -> DataFrame:
    """(run, slot, word): each run's filter, a row for each word that has a bit. At most 2**bits bits a run, whatever the rows."""
    at = filter_position(F.col("digest"), bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return digests.groupBy("run", filter_word(at).alias("slot")).agg(F.bit_or(bit).alias("word"))


def flush(entries: DataFrame) -> DataFrame:
    """Memtables to sorted runs: (run, digest, id, n)."""
    return entries.groupBy("run", "digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).sortWithinPartitions("run", "digest")


def merge(level: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """The runs of a level two by two: (run, digest, id, n) with half as many runs, each digest once in a run, its smallest id.

    A digest that its run's neighbour can't hold, by the neighbour's filter, passes as it is. The others are dealt by range of
    digests and sorted by run, digest and id; the window then walks the two runs side by side, two rows a digest at the most.
    """
    at = filter_position(F.col("digest"), bits)
    held = pages.select(F.col("run").bitwiseXOR(F.lit(1)).alias("run"), "slot", "word")
    # bounded by runs * 2**bits bits: 2 MB as the defaults stand
    probed = level.withColumn("slot", filter_word(at)).join(F.broadcast(held), ["run", "slot"], "left")
    probed = probed.select(F.expr("run div 2").cast("int").alias("run"), "digest", "id", "n", has_bit(F.col("word"), at).alias("met"))
    same = Window.partitionBy("digest", "run").orderBy(F.asc_nulls_last("id"))
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beside = probed.where("met").repartition("digest").withColumn("place", F.row_number().over(same)).withColumn("n", F.sum("n").over(whole))
    return beside.where("place = 1").select("run", "digest", "id", "n").unionByName(probed.where("not met").drop("met"))


def compact(level: DataFrame, runs: int, bits: int) -> DataFrame:
    """One run of all: (digest, id, n), the smallest id of each digest. Two runs become one at each level, until one is left;
    their filters are joined bit by bit."""
    pages = cut(filters(level, bits))
    while runs > 1:
        level = cut(merge(level, pages, bits))
        pages = pages.groupBy(F.expr("run div 2").cast("int").alias("run"), "slot").agg(F.bit_or("word").alias("word"))
        runs = -(-runs // 2)
    return level.select("digest", "id", "n")


def differing(docs: DataFrame, hits: DataFrame, norm: Column, digest, bits: int) -> DataFrame:
    """The digests among ``hits`` whose texts are not all the same bytes."""
    pages = filters(hits.withColumn("run", F.lit(0)), bits).select("slot", "word")
    texts = docs.select(norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    at = filter_position(F.col("digest"), bits)
    texts = texts.withColumn("slot", filter_word(at)).join(F.broadcast(pages), "slot", "left").where(has_bit(F.col("word"), at))
    same = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return same.where("low <> high").select("digest").join(hits.select("digest"), "digest", "left_semi")


def exact_groups(docs: DataFrame, smallest: bool = True, runs: int = 4, filter_bits: int = 22, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    smallest: keep the smallest doc_id of equal texts, else the largest (the index then orders identifiers from large to
    small). digest: from a normalised text to its binary digest.
    """
    norm = lower_ascii(F.col("text"))
    ident = F.col("doc_id") if smallest else F.bitwise_not("doc_id")  # turns the order, and any identifier has one
    made = docs.select("doc_id", "text").withColumn("norm", norm)
    entries = cut(made.select("doc_id", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("text_sha256")))
    found = _indexed(entries, ident, runs, filter_bits)
    hits = found.where("n > 1")
    odd = cut(differing(docs, hits, norm, digest, filter_bits))
    if not odd.isEmpty():
        texts = made.select("doc_id", "norm").withColumn("digest", digest(F.col("norm"))).withColumn("text_sha256", F.sha2("norm", 256))
        marked = texts.join(odd.withColumn("odd", F.lit(True)), "digest", "left")
        entries = cut(marked.select("doc_id", F.when(F.col("odd"), F.concat(F.col("digest"), F.encode("norm", "UTF-8"))).otherwise(F.col("digest")).alias("digest"), "text_sha256"))
        found = _indexed(entries, ident, runs, filter_bits)
        hits = found.where("n > 1")
    return _decided(entries, hits, smallest)


def _indexed(entries: DataFrame, ident: Column, runs: int, bits: int) -> DataFrame:
    dealt = entries.select(F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"), "digest", ident.alias("id"))
    return compact(cut(flush(dealt)), runs, bits)


def _decided(entries: DataFrame, hits: DataFrame, smallest: bool) -> DataFrame:
    total = entries.count()
    back = F.col("id") if smallest else F.bitwise_not("id")
    hits = hits.select(F.col("digest").alias("key"), back.alias("keep_id"), F.col("n").alias("group_size"))
    hot = hits.where(F.col("group_size") * HOT_PART > total).select(F.col("key").alias("digest"), F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    # at most HOT_PART rows; what they decide leaves the shuffled join, under a key of its own
    first = entries.join(F.broadcast(hot), "digest", "left")
    spread = first.withColumn("key", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.encode(F.concat(F.lit("row "), F.col("doc_id").cast("string")), "UTF-8")))
    joined = spread.join(hits.where(F.col("group_size") * HOT_PART <= total), "key", "left")
    keep = F.coalesce("hot_id", "keep_id", "doc_id")
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("hot_size", "group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the kept identifier, and one of them if rows
    repeat identifier and text. What an identifier's other rows say doesn't matter."""
    aside, names = set_aside(docs, "doc_id", "text")
    kept = exact_groups(docs, **how).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256").distinct()
    named = aside.withColumn("own", F.sha2(lower_ascii(F.col("text")), 256))
    met = named.join(kept, (F.col("own") == F.col("text_sha256")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    # partitioned and sorted as the join left it
    first = met.withColumn("place", F.row_number().over(Window.partitionBy("own", "doc_id").orderBy(F.lit(0)))).where("place = 1")
    return given_back(first, names, docs.columns)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), smallest=False)


ORACLE = {
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)"""
}
