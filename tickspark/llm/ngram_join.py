"""Near-duplicate documents by a rare-first prefix-filtered Jaccard join on five-word shingles.

1. Documents of equal shingle sets form one class (128-bit digest of the set); its smallest identifier stands for it.
2. Corpus-wide document frequencies of all shingles are counted by packed exchange (``exchange``).
3. A document's shingles are ordered rare-first. Those that no other class has can't be met; a document in which more
   than a quarter are of that kind can't link and leaves. Of the rest only a prefix takes part in the join.
4. Prefixes meet on shingles. To keep a large group from forming all its pairs, each shingle first links its documents
   with two leaders, in several turns with leaders of their own; links are verified, components formed, and then every pair that shares a prefix shingle and still
   lies in two components is tried, the largest component of a shingle on one side and large groups dealt by salt. Within
   that join a pair passes the length and positional filters and the suffix filter: the shingle on which two documents
   meet first has nothing shared before it, and behind it the parities of the shingles in BITS parts of the hash space
   bound the suffixes' Hamming distance from below. Hence what comes out are nearly only pairs that link, each of which
   is verified once, exactly; texts of one family that don't link are told apart within the join.
Components come out as if all links had been formed: a pair that isn't tried lies in one component already.

Edge cases: a null, empty or blank text has an empty set and links with nothing; a text of fewer than five words has its
whole sequence as its only shingle; rows that share an identifier count as one document; a null identifier stays alone;
a very long text makes a block of its own and has as many shingles as it has words; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm import exchange
from tickspark.llm.components import components
from tickspark.llm.spill import cut
from tickspark.llm.text import LOWER, SHINGLE_WORD, bounded_batches, given_back, gram_hash, mix, prefix_hash, raw, set_aside, slices, span_hash, text_bytes, word_spans

WORDS = 5
#: The similarity threshold as a fraction, and the parts of the hash space of which the suffix filter holds a parity.
OVER, UNDER = 3, 4
BITS = 512
#: Orders by which leaders are chosen.
ORDERS = 4
#: Documents outside a shingle's largest component that one task compares with its others.
SALTED = 1024
SETS = "doc_id long, n_shingles long, d1 long, d2 long"
SURVIVORS = "doc long, n int, lone int, parities array<long>, tokens array<long>, suffixes array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    for lo, hi in slices(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        cuts = offsets[lo : hi + 1] - offsets[lo]
        starts, ends, row = word_spans(part, cuts, SHINGLE_WORD)
        hashes = span_hash(prefix_hash(part), starts, ends)
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        grams = gram_hash(hashes, words)
        for i in range(hi - lo):
            a, b = edges[i], edges[i + 1]
            yield np.unique(grams[a : b - words + 1]) if b - a >= words else gram_hash(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(shingles ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (0x1234567, 0x89ABCDEF01))


def summaries(docs: DataFrame) -> DataFrame:
    """SETS of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(b.column("text"))
            rows = [(len(s), *digest(s)) for s in shingle_sets(data, offsets)]
            yield pa.record_batch([b.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["doc_id", "n_shingles", "d1", "d2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def _represented(texts: pa.Table, wanted: set[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, shingles) of the rows that stand for their class, each once."""
    ids, left = texts.column("doc_id").to_pylist(), set(wanted)
    named = {w[0] for w in wanted}
    at = [i for i, d in enumerate(ids) if d in named]
    data, offsets = raw(texts.column("text").take(pa.array(at, pa.int64())))
    for i, shingles in zip(at, shingle_sets(data, offsets), strict=True):
        key = (ids[i], *digest(shingles))
        if key in left:
            left.remove(key)
            yield ids[i], shingles


def _wanted(table: pa.Table) -> set[tuple[int, int, int]]:
    return {(d, x, y) for d, x, y in zip(*(table.column(c).to_pylist() for c in ("rep", "d1", "d2")), strict=True) if d is not None}


def survivors(docs: DataFrame, reps: DataFrame, n_bytes: int, block_bytes: int = 4 << 20) -> DataFrame:
    """SURVIVORS: of each representative that may link, its number of shingles, of those that no other has, the parities of
    the others, the others, rare-first, and the parities of what stands behind each shingle of the prefix, one after the
    other."""
    blocks, buckets = exchange.block_counts(n_bytes, block_bytes)
    bits = exchange.key_bits(n_bytes)
    shift = np.uint64(64 - bits)
    texts = exchange.by_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), blocks).groupBy("block")
    reps = exchange.by_block(reps.select(F.col("rep").alias("doc_id"), "rep", "d1", "d2"), blocks).drop("doc_id")

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [s >> shift for _, s in _represented(left, _wanted(right))]
        keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return exchange.requests(key[0].as_py(), {0: (keys, counts)}, buckets, bits)

    answers = exchange.totals(texts.cogroup(reps.groupBy("block")).applyInArrow(ask, exchange.REQUEST))
    told = answers.unionByName(reps, allowMissingColumns=True)

    def order(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_represented(left, _wanted(right)))
        flat = np.concatenate([s for _, s in found] or [np.zeros(0, np.uint64)])
        keys, back = np.unique(flat >> shift, return_inverse=True)
        often = exchange.answered(right, 0, keys, buckets, bits)[back]
        edges = np.cumsum([0, *(len(s) for _, s in found)])
        met_before = np.concatenate([[0], np.cumsum(often > 1)])
        many = np.diff(met_before[edges])
        out: dict[str, list] = {"doc": [], "n": [], "lone": [], "parities": [], "tokens": [], "suffixes": []}
        for i in np.flatnonzero(UNDER * many >= OVER * np.diff(edges)):
            (doc, shingles), own = found[i], often[edges[i] : edges[i + 1]]
            met = shingles[own > 1]
            met = met[np.lexsort((met, own[own > 1]))].view(np.int64)
            whole, suffixes = parities(met, prefix_length(len(shingles), len(shingles) - len(met)))
            for name, value in (("doc", doc), ("n", len(shingles)), ("lone", len(shingles) - len(met)), ("parities", whole), ("tokens", met), ("suffixes", suffixes)):
                out[name].append(value)
        return pa.table({n: pa.array(v, pa.int64() if n == "doc" else pa.int32() if n in ("n", "lone") else pa.list_(pa.int64())) for n, v in out.items()})

    return texts.cogroup(told.groupBy("block")).applyInArrow(order, SURVIVORS)


def prefix_length(n: int, lone: int) -> int:
    """How many of the shingles that others have too belong to the prefix of a set of ``n``, after the ``lone`` ones."""
    return max(0, n - -(-OVER * n // UNDER) + 1 - lone)


def parities(tokens: np.ndarray, taken: int) -> tuple[np.ndarray, np.ndarray]:
    """Parities of all tokens in BITS parts, as 64-bit words; and those of the tokens behind each of the first ``taken``."""
    place = tokens & (BITS - 1)
    steps = np.zeros((len(tokens), BITS // 64), np.uint64)
    steps[np.arange(len(tokens)), place >> 6] = np.uint64(1) << (place & 63).astype(np.uint64)
    whole = np.bitwise_xor.reduce(steps, axis=0)
    return whole.view(np.int64), (np.bitwise_xor.accumulate(steps[:taken], axis=0) ^ whole).reshape(-1).view(np.int64)


def _prefixes(held: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(token, doc, n, at, label, behind): a row for each shingle of a prefix; ``at`` is its place in the rare-first order,
    ``behind`` has the parities of what follows it."""
    words = BITS // 64
    own = held if labels is None else held.join(labels, held.doc == labels.node, "left")
    label = F.col("doc") if labels is None else F.coalesce("component", "doc")
    taken = F.slice("tokens", F.lit(1), (F.size("suffixes") / words).cast("int"))
    rows = own.select("doc", "n", "lone", "suffixes", label.alias("label"), F.posexplode(taken).alias("i", "token"))
    return rows.select("token", "doc", "n", (F.col("lone") + F.col("i")).alias("at"), "label", F.slice("suffixes", F.col("i") * words + 1, F.lit(words)).alias("behind"))


def _may_link(x: str, y: str):
    """Length and positional filters between two prefix rows (columns with these beginnings)."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    rest = F.least(n - F.col(f"{x}at"), m - F.col(f"{y}at"))
    return (UNDER * F.least(n, m) >= OVER * F.greatest(n, m)) & ((OVER + UNDER) * rest >= OVER * (n + m))


def _suffixes_may_link(x: str, y: str):
    """Suffix filter between two prefix rows: no shingle before the first on which two documents meet is in both sets, so
    those and the parities that differ behind it bound the sets' Hamming distance, which must be a seventh of their sizes."""
    apart = sum((F.bit_count(F.col(f"{x}behind")[i].bitwiseXOR(F.col(f"{y}behind")[i])) for i in range(BITS // 64)), F.col(f"{x}at") + F.col(f"{y}at"))
    return (OVER + UNDER) * apart <= (UNDER - OVER) * (F.col(f"{x}n") + F.col(f"{y}n"))


def _named(df: DataFrame, start: str, *keys: str) -> DataFrame:
    return df.select("token", *keys, *(F.col(c).alias(start + c) for c in ("doc", "n", "at", "label", *(("behind",) if "behind" in df.columns else ()))))


def _led(prefixes: DataFrame, turn: int) -> DataFrame:
    """Candidate pairs of each document with two leaders of each shingle that lies in several components.

    Leaders are the first and last document under an order by hash, one of ``ORDERS`` orders for each shingle and others in
    each turn: the documents of a large group meet many leaders, yet each of them a bounded number.
    """
    rank = F.xxhash64("doc", F.pmod(F.col("token"), F.lit(ORDERS)), F.lit(turn))
    one = F.struct(rank.alias("h"), "doc", "n", "at", "label")
    lead = prefixes.groupBy("token").agg(F.min(one).alias("x"), F.max(one).alias("z"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    lead = lead.select("token", F.explode(F.array("x", "z")).alias("x")).select("token", *(F.col(f"x.{c}").alias(f"x_{c}") for c in ("doc", "n", "at", "label")))
    return _each_once(_named(prefixes.drop("behind"), "y_").join(lead, "token").where(F.col("x_label") != F.col("y_label")).where(_may_link("x_", "y_")))


def _crossed(prefixes: DataFrame) -> DataFrame:
    """All candidate pairs between components: rows outside a shingle's largest component against all of its rows."""
    sizes = prefixes.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    main = main.select("token", F.col("m.label").alias("main"), F.ceil((F.col("all") - F.col("m.k")) / SALTED).cast("int").alias("salts"))
    rows = prefixes.join(main, "token")
    left = _named(rows.where("label <> main").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")), "x_", "salt")
    right = _named(rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "y_", "salt")
    on = (left.token == right.token) & (left.salt == right.salt) & (F.col("x_label") != F.col("y_label")) & _may_link("x_", "y_") & _suffixes_may_link("x_", "y_")
    return _each_once(left.join(right, on))


def _each_once(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose sets reach the threshold: parities of the whole sets first, then the exact intersection."""
    side = lambda x, *also: held.select(F.col("doc").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in also))
    both = pairs.join(side("a", "n", "lone", "parities"), "a").join(side("b", "n", "lone", "parities"), "b")
    apart = sum((F.bit_count(F.col("a_parities")[i].bitwiseXOR(F.col("b_parities")[i])) for i in range(BITS // 64)), F.lit(0))
    total = F.col("a_n") + F.col("b_n")
    near = both.where((OVER + UNDER) * (total - F.col("a_lone") - F.col("b_lone") - apart) >= 2 * OVER * total).select("a", "b", total.alias("total"))
    met = near.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    return met.where((OVER + UNDER) * F.size(F.array_intersect("a_tokens", "b_tokens")) >= OVER * F.col("total")).select("a", "b")


def linked(held: DataFrame, parts: int | None = None, turns: int = 3) -> DataFrame:
    """(node, component) of all survivors that link with another one. parts: see ``cut``."""
    labels, links = None, None
    for turn in range(turns + 1):
        prefixes = _prefixes(held, labels)
        tried = _verified(cut(_led(prefixes, turn) if turn < turns else _crossed(prefixes), parts), held)
        links = tried if links is None else tried.unionByName(links)
        labels = cut(components(links, parts), parts)
        links = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return labels


def near_duplicates(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    n_bytes = text_bytes(docs)
    parts = max(8, exchange.block_counts(n_bytes, block_bytes)[0])
    sets = cut(summaries(docs), parts)
    some = sets.where("n_shingles > 0 and doc_id is not null")
    classes = cut(some.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")), parts)
    # classes with several rows join as edges to their representative, so that one identifier in two classes links them
    labels = linked(cut(survivors(docs, classes, n_bytes, block_bytes), parts), parts)
    own = some.join(classes.where("k > 1"), ["n_shingles", "d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    mapped = own.join(labels, own.b == labels.node, "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    every = labels.unionByName(mapped).groupBy("node").agg(F.min("component").alias("component"))
    return sets.join(every, sets.doc_id == every.node, "left").select("doc_id", "n_shingles", F.least(F.coalesce("component", "doc_id"), "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component, with all their columns."""
    stay = near_duplicates(docs, **how).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("kept_id")).distinct()
    aside, names = set_aside(docs, "doc_id")
    return given_back(aside.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi"), names, docs.columns)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
