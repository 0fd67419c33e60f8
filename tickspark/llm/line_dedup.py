"""Fuzzy line deduplication by MinHash, in DataFrame and SQL functions only.

A line's set holds its character shingles: SHINGLE characters (UTF-16 units) from each of its characters on, lower-cased,
ends trimmed. Every distinct line gets a signature of ROWS * bands minima of its hashed shingles: the shingles are dealt to
CLASSES by their hash, and a minimum is taken in one class under one of several orders (an empty class borrows from the
next), which costs a fraction of minima over the whole set. ROWS minima make a band, lines with equal minima a bucket.
Lines are compared with their buckets' two leaders, by exact Jaccard similarity of their sets; similar pairs are joined into
components by distributed union-find; then all pairs of a bucket that still lie in two components are compared, so that
components come out as if all pairs of all buckets had been. Of each component, exact copies included, the first line
(smallest identifier, then line number) stays and all others go.

A similar pair meets in a band with probability 1 - (1 - s ** ROWS) ** bands: 0.996 at s = 0.75, 0.9992 at 0.8 and 0.999998
at 0.9, as the defaults stand (a little less for lines of under 20 characters). Before the sets of
lines that share a bucket are compared, their sizes bound the sets' distance from below, beside leaders, and bitmaps of WORDS * 64 bits
of the two lines' shingles, in buckets that still lie in two components; this loses nothing. And two lines of LONG or more shingles must agree in AGREED minima: at s = 0.75 some 22 of 30 agree, and fewer than
AGREED with a chance of 3 in 10,000. A distinct line is named by a 64-bit hash.

Edge cases: a null or empty text has one empty line; blank lines always stay; a line shorter than a shingle has one
shingle; a very long line is one set like any other; rows that share an identifier share the decisions of their line
numbers, so repeated rows stay equal; lines of rows with a null identifier never go; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.components import components
from tickspark.llm.exact_dedup import filter_position, filter_word, filters, has_bit
from tickspark.llm.spill import cut, stored

SHINGLE = 8
ROWS, BANDS = 3, 10  # no more than 16 bands
#: Classes of shingles, and by how many bits one order's hash is shifted against the next.
CLASSES, SHIFT = 8, 12
#: Shingles from which on a line's minima are compared before its set, and how many of them must agree.
LONG, AGREED = 64, 14
#: Minima, a byte of each, in a word of the sketch that is compared.
PACKED = 6
#: Words of a line's bitmap of shingles.
WORDS = 32
#: Lines outside a bucket's largest component that one task compares with the bucket.
SALTED = 1024
#: Similarity at which lines count as near copies, as a fraction.
OVER, UNDER = 3, 4
#: Lines of a key above this part of all make it hot; there can't be more than this many hot keys.
HOT_PART = 1000


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, at, key, norm): the lines that are not blank, normalised, and their 64-bit names."""
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).where("trim(line) <> ''")
    return split.select("doc_id", "at", F.lower(F.trim("line")).alias("norm")).select("doc_id", "at", F.xxhash64("norm").alias("key"), "norm")


def wide(norm: Column) -> Column:
    """A normalised line as two bytes a character, no shorter than a shingle: any place in it is found at once."""
    return F.encode(F.when(F.length(norm) < SHINGLE, F.rpad(norm, SHINGLE, " ")).otherwise(norm), "UTF-16BE")


def places(line: Column) -> Column:
    return F.sequence(F.lit(1), F.octet_length(line) - (2 * SHINGLE - 1), F.lit(2))


def shingle(line: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(line, at, F.lit(2 * SHINGLE)))


def shingles(norm: Column) -> Column:
    """The 64-bit hashes of the shingles of a normalised line, not yet distinct."""
    # the array of one names the encoded line, which would else be made anew for each shingle
    every = F.transform(F.array(wide(norm)), lambda line: F.transform(places(line), lambda i: shingle(line, i)))
    return F.element_at(every, 1)


def hashes(rows: DataFrame) -> DataFrame:
    """(key, h): the hash of each shingle of each line, not yet distinct."""
    made = rows.select("key", wide(F.col("norm")).alias("line"))
    return made.select("key", "line", F.explode(places(F.col("line"))).alias("i")).select("key", shingle(F.col("line"), F.col("i")).alias("h"))


def signatures(rows: DataFrame, bands: int) -> DataFrame:
    """(key, buckets, s0, s1, ...): of each distinct line a bucket for each band, whose low bits number the band, and a byte of
    each minimum. Minima have 24 bits."""
    hashed = hashes(rows).withColumn("class", F.col("h").bitwiseAND(F.lit(CLASSES - 1).cast("long")).cast("int"))
    orders = -(-ROWS * bands // CLASSES)
    # the filter of an aggregate is what keeps the other classes' minima untouched
    least = [F.expr(f"min(cast(shiftrightunsigned(shiftleft(h, {SHIFT * j}), 40) as int)) FILTER (WHERE class = {c})").alias(f"l{j}_{c}") for j in range(orders) for c in range(CLASSES)]
    # each class borrows from the next one that has borrowed already: chains of all classes for each minimum make a method too long to be compiled
    borrowed = hashed.groupBy("key").agg(*least)
    for c in reversed(range(CLASSES)):
        after = range(CLASSES - 1) if c == CLASSES - 1 else [c + 1]
        borrowed = borrowed.withColumns({f"l{j}_{c}": F.coalesce(f"l{j}_{c}", *(f"l{j}_{k}" for k in after)) for j in range(orders)})
    minima = borrowed.select("key", *(F.col(f"l{i // CLASSES}_{i % CLASSES}").alias(f"m{i}") for i in range(ROWS * bands)))
    met = [F.xxhash64(*(f"m{ROWS * i + k}" for k in range(ROWS))).bitwiseAND(F.lit(-16)).bitwiseOR(F.lit(i).cast("long")) for i in range(bands)]
    byte = lambda i, k: F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(255)).cast("long"), 8 * k)
    words = [reduce(Column.bitwiseOR, (byte(i, k) for k, i in enumerate(range(at, min(at + PACKED, ROWS * bands))))) for at in range(0, ROWS * bands, PACKED)]
    return minima.select("key", F.array(*met).alias("buckets"), *(w.alias(f"s{i}") for i, w in enumerate(words)))


def sketches(texts: DataFrame, signed: DataFrame) -> DataFrame:
    """(key, norm, size) and the columns of ``signed``: of each wanted line its number of distinct shingles."""
    return texts.select("key", "norm", F.size(F.array_distinct(shingles(F.col("norm")))).alias("size")).join(signed, "key")


def bitmaps(texts: DataFrame) -> DataFrame:
    """(key, held0, held1, ...): a bitmap of each line's shingles."""
    bit = "bit_or(shiftleft(1L, cast(shiftrightunsigned(h, 40) & 63 as int)))"
    held = [F.expr(f"coalesce({bit} FILTER (WHERE slot = {w}), 0L)").alias(f"held{w}") for w in range(WORDS)]
    # bits 40 to 50 of a shingle's hash name its bit: six within a word, the rest the word
    return hashes(texts).withColumn("slot", F.call_function("shiftrightunsigned", "h", F.lit(46)).bitwiseAND(F.lit(WORDS - 1).cast("long")).cast("int")).groupBy("key").agg(*held)


def numbered_columns(df: DataFrame, name: str) -> list[str]:
    return [c for c in df.columns if c.startswith(name) and c[len(name) :].isdigit()]


def sketched(signed: DataFrame) -> list[str]:
    """The columns that ``may_be_similar`` takes."""
    return ["size", *numbered_columns(signed, "held"), *numbered_columns(signed, "s")]


def members(signed: DataFrame, filter_bits: int) -> DataFrame:
    """(bucket, key, low, high): the lines of each bucket that holds several, and its two leaders, the first and last name."""
    rows = signed.select("key", F.explode("buckets").alias("bucket"))
    leaders = cut(rows.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high"))
    return held_by(rows, leaders.select(F.col("bucket").alias("digest")), F.col("bucket"), filter_bits).join(leaders, "bucket")


def led(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each line with the leaders of its buckets, each once."""
    both = met.select("key", F.explode(F.array("low", "high")).alias("leader")).where("key <> leader")
    return both.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()


def crossed(met: DataFrame, labels: DataFrame, signed: DataFrame) -> DataFrame:
    """All other similar pairs (a, b) of a bucket that still lie in two components, each once.

    Leaders have been compared with all. Of the others those outside the bucket's largest component meet all; large
    buckets are dealt by salt. Bitmaps are made here, for these buckets' lines only, where ``signed`` has none. Sketches are compared within the join, and then the lines' sets where ``signed`` holds the lines
    (else pairs that may be similar are returned), so that pairs of unlike lines don't come out of it. Where it holds their
    buckets, a pair is compared in the first bucket that it shares: there it is in two components as well, or a leader's.
    """
    rest = met.where("key <> low and key <> high").select("bucket", "key").join(labels, F.col("key") == F.col("node"), "left")
    rest = rest.select("bucket", "key", F.coalesce("component", "key").alias("label"))
    sizes = rest.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    main = main.select("bucket", F.col("m.label").alias("main"), F.ceil((F.col("n") - F.col("m.k")) / SALTED).cast("int").alias("salts"))
    rows = rest.join(main, "bucket")
    if "norm" in signed.columns and not numbered_columns(signed, "held"):
        rows = cut(rows)
        few = signed.join(rows.select("key").distinct(), "key", "left_semi")
        signed = stored(few.join(bitmaps(few), "key"))  # both sides of the join read it
    sketch = sketched(signed)
    kept = [*sketch, *(c for c in ("norm", "buckets") if c in signed.columns)]
    rows = rows.join(signed.select("key", *kept), "key")
    named = lambda df, x: df.select("bucket", "salt", *(F.col(c).alias(f"{x}_{c}") for c in ("key", "label", "main", *kept)))
    left = named(rows.where("label <> main").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")), "x")
    right = named(rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "y")
    # two lines outside the largest component meet in both orders
    on = (left.bucket == right.bucket) & (left.salt == right.salt) & (F.col("x_label") != F.col("y_label")) & ((F.col("y_label") == F.col("y_main")) | (F.col("x_key") < F.col("y_key")))
    if "buckets" in kept:
        band = left.bucket.bitwiseAND(F.lit(15).cast("long"))
        earlier = lambda i: (F.lit(i) < band) & (F.get("x_buckets", F.lit(i)) == F.get("y_buckets", F.lit(i)))
        on = on & ~reduce(Column.__or__, (F.coalesce(earlier(i), F.lit(False)) for i in range(BANDS)))
    on = on & may_be_similar("x", "y", sketch)
    if "norm" in kept:
        on = on & are_similar(*(F.col(f"{x}_{c}") for c in ("norm", "size") for x in "xy"))
    return left.join(right, on).select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()


def marked(rows: DataFrame, digests: DataFrame, value: Column, filter_bits: int) -> DataFrame:
    """``rows`` with ``maybe``: whether the value may be among ``digests``, by a bitmap filter of fixed size."""
    pages = filters(digests.withColumn("run", F.lit(0)), filter_bits).select("slot", "word")
    place = filter_position(value, filter_bits)
    return rows.withColumn("slot", filter_word(place)).join(F.broadcast(pages), "slot", "left").withColumn("maybe", has_bit(F.col("word"), place)).drop("slot", "word")


def held_by(rows: DataFrame, digests: DataFrame, value: Column, filter_bits: int) -> DataFrame:
    """The rows that may be among ``digests``: others needn't enter a shuffle."""
    return marked(rows, digests, value, filter_bits).where("maybe").drop("maybe")


def found_lines(docs: DataFrame, wanted: DataFrame, filter_bits: int) -> DataFrame:
    """(doc_id, at, key, norm): every line, with its text if it may be wanted, by a bitmap filter of fixed size."""
    rows = marked(lines(docs), wanted.select(F.col("key").alias("digest")), F.col("key"), filter_bits)
    return rows.select("doc_id", "at", "key", F.when(F.col("maybe"), F.col("norm")).alias("norm"))


def may_be_similar(x: str, y: str, sketch: list[str]) -> Column:
    """Whether the sketches of two lines (columns of these beginnings) allow for the threshold."""
    ones = int("7f" * 7, 16)

    def equal_bytes(word: str) -> Column:
        """How many of the seven low bytes are equal: those of the difference that carry nothing into their high bit."""
        apart = F.col(f"{x}_{word}").bitwiseXOR(F.col(f"{y}_{word}"))
        return F.bit_count(F.bitwise_not((apart.bitwiseAND(F.lit(ones)) + F.lit(ones)).bitwiseOR(apart).bitwiseOR(F.lit(ones)))) - 8  # the bits of the eighth byte

    words, held = ([c for c in sketch if c.startswith(n) and c != "size"] for n in ("s", "held"))
    unused = PACKED * len(words) - ROWS * BANDS
    agreed = reduce(Column.__add__, (equal_bytes(w) - (7 - PACKED) for w in words)) - unused
    # a bit that one of them lacks is a shingle that one of them lacks; without bitmaps the sizes tell how many at the least
    bits = [F.bit_count(F.col(f"{x}_{w}").bitwiseXOR(F.col(f"{y}_{w}"))) for w in held]
    apart = reduce(Column.__add__, bits) if bits else F.abs(F.col(f"{x}_size") - F.col(f"{y}_size"))
    close = (OVER + UNDER) * apart <= (UNDER - OVER) * (F.col(f"{x}_size") + F.col(f"{y}_size"))
    return close & ((F.least(f"{x}_size", f"{y}_size") < LONG) | (agreed >= AGREED))


def are_similar(x: Column, y: Column, x_size: Column, y_size: Column) -> Column:
    """Whether the sets of two lines, of so many distinct shingles, reach the threshold."""
    return (OVER + UNDER) * F.size(F.array_intersect(shingles(x), shingles(y))) >= OVER * (x_size + y_size)


def similar(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold. Sets are made of the texts here: they are many times larger."""
    sketch = sketched(signed)
    side = lambda x, *also: signed.select(F.col("key").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in also))
    near = pairs.join(side("a", *sketch), "a").join(side("b", *sketch), "b").where(may_be_similar("a", "b", sketch))
    both = near.select("a", "b", "a_size", "b_size").join(side("a", "norm"), "a").join(side("b", "norm"), "b")
    return both.where(are_similar(*(F.col(f"{x}_{c}") for c in ("norm", "size") for x in "ab"))).select("a", "b")


def dropped_lines(docs: DataFrame, bands: int = BANDS, filter_bits: int = 23) -> DataFrame:
    """(doc_id, at, component): every line that goes, and the smallest name of a line in its component."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    every = cut(signatures(lines(docs), bands))
    parts = max(8, every.rdd.getNumPartitions() // 4)  # links are few beside lines
    met = cut(members(every, filter_bits))
    wanted = met.select("key").distinct()
    found = stored(found_lines(docs, wanted, filter_bits))
    # aggregated before the join, so that a frequent line is one row of each task
    texts = stored(found.where("norm is not null").groupBy("key").agg(F.min("norm").alias("norm")).join(wanted, "key"))
    signed = stored(sketches(texts, held_by(every, wanted.select(F.col("key").alias("digest")), F.col("key"), filter_bits)))
    labels = cut(components(similar(led(met), signed), parts), parts)
    more = crossed(met, labels, signed)
    joined = cut(components(more.unionByName(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))), parts), parts)
    found = found.select("doc_id", "at", "key")
    total = found.count()
    named = cut(found.groupBy("key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n")).join(joined, F.col("key") == joined.node, "left").where("n > 1 or node is not null").select("key", "doc", "n", F.coalesce("component", "key").alias("component")))
    first = named.groupBy("component").agg(F.min("doc").alias("keep_doc"))
    # lines that are alone under their name and in their component can't go
    told = cut(named.join(first, "component").select("key", "component", "keep_doc", "n"))
    hot = told.where(F.col("n") * HOT_PART > total)
    met = cut(found.join(F.broadcast(hot), "key").unionByName(found.join(told.where(F.col("n") * HOT_PART <= total), "key")))
    stay = met.where("doc_id = keep_doc").groupBy("doc_id", "component").agg(F.min("at").alias("at"))
    return met.select("doc_id", "at", "component").distinct().join(stay, ["doc_id", "at", "component"], "left_anti")


def dedup_lines(docs: DataFrame, filter_bits: int = 23, **how) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row: the text of the lines that stay. Only texts that may lose a line are
    shuffled to meet their lines' decisions."""
    gone = cut(dropped_lines(docs, filter_bits=filter_bits, **how).groupBy("doc_id").agg(F.collect_list("at").alias("gone")))  # at most a document's own lines
    rows = marked(docs.select("doc_id", "text"), gone.select(F.col("doc_id").alias("digest")), F.col("doc_id"), filter_bits)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    whole = rows.where("not maybe").select("doc_id", n_lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text")
    met = rows.where("maybe").join(gone, "doc_id", "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    stays = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("gone", i)))
    met = met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), stays.alias("stays"))
    return whole.unionByName(met.select("doc_id", "n_lines", (F.col("n_lines") - F.size("stays")).cast("long").alias("n_dropped"), F.array_join("stays", "\n").alias("text")))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
