"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Texts are cut into pieces of at most ``capacity`` words; pieces are dealt by hash to shards of at most about ``shard_rows``
pieces (their number is bounded from the texts' bytes, as a word has two with its blank), and each shard packs its pieces from long to short. A bin carries a bitmap of sources and one of duplicate clusters; a
piece fits a bin if it has room and neither bitmap has the piece's bits. Open bins are ordered by residual room: the
search starts at the least residual that holds the piece and goes on to the next larger ones until a compatible bin, which
is the tightest, is found; else a new bin opens. The number of shards grows with the table, so a shard stays bounded, and
a hot source or cluster is spread over all shards.

Edge cases: a null or empty text, or one of blanks only, has one row with 0 words and no bin; a null source or cluster
conflicts with nothing; equal pieces are taken in the order of identifier and piece; repeated rows are packed each; the
pieces of a very long text are spread over all shards; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.exact_dedup import lower_ascii

CAPACITY = 2048
WORD = r"[^\x20\x09-\x0D]+"
PLACED = "doc_id long, piece int, n_words int, bin_id long, start int, residual int"


def bit_places(values: list) -> tuple[np.ndarray, int]:
    """For each value the number of its bit, -1 for a null or a value that no other row shares; and the bits in all."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    places = {v: i for i, v in enumerate(v for v, n in seen.items() if n > 1 and v is not None)}
    return np.array([places.get(v, -1) for v in values], np.int64), len(places)


class Bins:
    """Bins ordered by residual room, with a bitmap for each kind of conflict."""

    def __init__(self, capacity: int, most: int, bits: list[int]):
        self.capacity, self.n = capacity, 0
        self.room, self.which = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.maps = [np.zeros((most, (b + 63) // 64), np.uint64) for b in bits]

    def place(self, size: int, bits: tuple[int, ...]) -> tuple[int, int]:
        """(bin, words in it before) of the tightest compatible bin; opens one if there is none."""
        at, step = int(np.searchsorted(self.room[: self.n], size)), 64
        found = -1
        while at < self.n:
            tried = self.which[at : min(at + step, self.n)]
            clash = np.zeros(len(tried), bool)
            for held, bit in zip(self.maps, bits, strict=True):
                if bit >= 0:
                    clash |= (held[tried, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 1
            free = np.flatnonzero(~clash)
            if len(free):
                found = at + int(free[0])
                break
            at, step = at + len(tried), step * 2
        if found < 0:
            found, own, room = self.n, self.n, self.capacity
            self.n += 1
        else:
            own, room = int(self.which[found]), int(self.room[found])
        for held, bit in zip(self.maps, bits, strict=True):
            if bit >= 0:
                held[own, bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)
        to = int(np.searchsorted(self.room[:found], room - size, side="right"))
        self.room[to + 1 : found + 1], self.which[to + 1 : found + 1] = self.room[to:found].copy(), self.which[to:found].copy()
        self.room[to], self.which[to] = room - size, own
        return own, self.capacity - room


def pack_shard(sizes: np.ndarray, conflicts: list[list], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, start in it and the bin's final residual, for pieces in the order to be placed."""
    places = [bit_places(c) for c in conflicts]
    bins = Bins(capacity, len(sizes), [n for _, n in places])
    put = [bins.place(int(s), tuple(int(p[i]) for p, _ in places)) for i, s in enumerate(sizes)]
    own, start = (np.array([p[k] for p in put], np.int64) for k in (0, 1))
    final = np.zeros(len(sizes), np.int64)
    final[bins.which[: bins.n]] = bins.room[: bins.n]
    return own, start, final[own]


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, shard_rows: int = 16_384) -> DataFrame:
    """PLACED for every piece: which bin holds it, from which word, and what room the bin has left.

    cluster: the duplicate cluster of a row; by default rows of equal text (A-Z lower-cased) are one.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    cluster = cluster if cluster is not None else F.when(words > 0, F.xxhash64(lower_ascii(F.col("text"))))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"), F.col("source").cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    full = F.greatest(F.ceil(F.col("words") / capacity), F.lit(1)).cast("int")
    pieces = sized.select("doc_id", "source", "cluster", "words", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    pieces = pieces.withColumn("n_words", F.least(F.col("words") - F.col("piece") * capacity, F.lit(capacity)).cast("int"))
    most = docs.agg(F.sum(F.greatest(F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / (2 * capacity)), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(most) // shard_rows))
    dealt = pieces.select("doc_id", "piece", "n_words", "source", "cluster", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = np.asarray(table.column("n_words"))
        n = int((sizes > 0).sum())
        own, start, residual = pack_shard(sizes[:n], [table.column(c).slice(0, n).to_pylist() for c in ("source", "cluster")], capacity)
        shard = table.column("shard")[0].as_py() << 32
        none = [None] * (len(sizes) - n)
        return pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "n_words": table.column("n_words"), "bin_id": pa.array((own + shard).tolist() + none, pa.int64()), "start": pa.array(start.tolist() + none, pa.int32()), "residual": pa.array(residual.tolist() + none, pa.int32())})

    return dealt.groupBy("shard").applyInArrow(run, PLACED)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
