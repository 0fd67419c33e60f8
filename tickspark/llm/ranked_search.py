"""Ranked lexical search over a sharded inverted index, document at a time.

Index: a task gathers the texts of its partition into shards of bounded size. A shard numbers its documents in the order of
their identifiers and holds, for each of its terms, how many documents have it and the postings: gaps between document
numbers and occurrences, as variable-length bytes. One more row of a shard, without a term, holds the identifiers and lengths.

Search: document frequencies, the number of documents and the number of terms are summed over all shards. Queries are dealt
into blocks of bounded size; the postings of a block's terms in one shard meet in one group. There a query's lists are walked
document at a time: a heap holds the next document of each list, the least one is taken from all lists that stand on it
and scored, and a second heap keeps the best documents, keyed by score, then identifier. Lists whose largest contributions
together can't lift a document into a full heap needn't lead: they are only looked up for documents that others bring. The
best of all shards are merged by a ranking for each query.

score = sum over the query's terms, repeats included, of w * ((SCALE * tf) div (1000 * tf + 12 * m)), in whole numbers, where
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 75 + (25 * n * N) div L for a document of n terms.

Edge cases: a null or empty text has no terms, doesn't count in N and is never found; a query without terms, or whose terms
no document has, gives no rows; rows that share an item_id are one query whose terms add up, a null one among them; rows that
repeat a doc_id are documents each; of equal scores the smaller doc_id comes first, a null one last; a very long text is
split piece by piece and is one document; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heappushpop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.spill import cut
from tickspark.llm.text import LOWER, bounded_batches

TOP = 20
SCALE = 10**9
#: Bytes of text in a shard, and of a text that are split at once.
SHARD_BYTES, PIECE = 32 << 20, 1 << 22
#: Queries in a block, and copies of a query's terms over which the shards' postings are dealt where both meet.
BLOCK, SALTS = 256, 16
#: Bytes up to which the queries' terms are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of terms (ASCII letters and digits, letters lower-cased, and all beyond ASCII); others become a space.
TERM_BYTES = bytes(LOWER[c] if bytes([c]).isalnum() or c >= 0x80 else 32 for c in range(256))
INDEX = "shard long, term string, df long, docs long, total long, postings binary"


def counted(text: str | None, piece: int = PIECE) -> Counter:
    """The terms of a text with their occurrences."""
    data = (text or "").encode().translate(TERM_BYTES)
    out: Counter = Counter()
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + piece)
        hi = len(data) if hi < 0 else hi
        out.update(data[lo:hi].split())
        lo = hi
    return out


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as groups of seven bits, low ones first, the last without its top bit; and where each one ends."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for k in range(1, 10):
        width += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max()) if len(width) else 0):
        has = width > k
        part = (values[has] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F
        out[ends[has] - width[has] + k] = part | np.where(width[has] > k + 1, 0x80, 0).astype(np.uint8)
    return out, ends


def from_bytes(blob: bytes) -> np.ndarray:
    data = np.frombuffer(blob, np.uint8)
    last = np.flatnonzero(data < 0x80)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max()) + 1 if len(last) else 0):
        has = first + k <= last
        out[has] |= (data[first[has] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


class Shard:
    """Documents gathered for one shard."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict()  # of terms, in the order in which they come up
        self.numbers.default_factory = self.numbers.__len__
        self.docs: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        terms = counted(text)
        if terms:
            self.docs.append((doc_id, np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)), np.fromiter(terms.values(), np.int64, len(terms))))
        self.bytes += len(text or "") + 64

    def rows(self, shard: int) -> pa.RecordBatch:
        """INDEX rows: the documents, then a row for each term."""
        self.docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
        lengths = np.array([d[2].sum() for d in self.docs], np.int64)
        sizes = [len(d[1]) for d in self.docs]
        term, tf = (np.concatenate([d[k] for d in self.docs]) for k in (1, 2))
        place = np.repeat(np.arange(len(self.docs)), sizes)
        order = np.argsort(term, kind="stable")  # documents stay in order within a term
        term, tf, place = term[order], tf[order], place[order]
        df = np.bincount(term, minlength=len(self.numbers))
        edges = np.concatenate([[0], np.cumsum(df)])
        gaps = np.diff(place, prepend=0)
        gaps[edges[:-1]] = place[edges[:-1]]
        data, ends = to_bytes(np.column_stack([gaps, tf]).reshape(-1))
        cuts = np.concatenate([[0], ends])[2 * edges]
        postings = pa.Array.from_buffers(pa.large_binary(), len(df), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
        known = pa.array([d[0] for d in self.docs], pa.int64())
        head = np.asarray(known.fill_null(0)).astype("<i8").tobytes() + np.asarray(known.is_null()).astype("u1").tobytes() + lengths.astype("<i8").tobytes()
        n = len(df) + 1
        none = lambda value, rest: pa.concat_arrays([pa.array([value], pa.int64()), rest])
        nulls = pa.nulls(n - 1, pa.int64())
        return pa.record_batch([pa.repeat(pa.scalar(shard, pa.int64()), n), pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(list(self.numbers), pa.binary()).cast(pa.string())]), none(None, pa.array(df, pa.int64())), none(len(self.docs), nulls), none(int(lengths.sum()), nulls), pa.concat_arrays([pa.array([head], pa.binary()), postings])], ["shard", "term", "df", "docs", "total", "postings"])


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """INDEX of all terms of all texts. Write it (``cut``, or a table) before it is searched."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = Shard(), 0
        for b in batches:
            base = b.column("part")[0].as_py() << 32 if b.num_rows else 0
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                own.add(doc_id.as_py(), text.as_py())
                if own.bytes >= shard_bytes:
                    if own.docs:
                        yield own.rows(base + made)
                    own, made = Shard(), made + 1
        if own.docs:
            yield own.rows(base + made)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, INDEX)


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term, times): each query's terms and how often it has them."""
    bounded_batches(queries.sparkSession)
    kind = dict(queries.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counted(t.as_py()) for t in b.column("text")]
            items = b.column("item_id").take(pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c in found]), pa.int64()))
            terms = pa.array([t for c in found for t in c], pa.binary()).cast(pa.string())
            yield pa.record_batch([items, terms, pa.array([n for c in found for n in c.values()], pa.int64())], ["item_id", "term", "times"])

    rows = queries.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string, times long")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Postings:
    """A term's documents in a shard, ascending, and what each one's score gains for a weight of 1."""

    __slots__ = ("numbers", "parts", "most", "_by_number")

    def __init__(self, numbers: np.ndarray, parts: np.ndarray):
        self.numbers, self.parts, self.most, self._by_number = numbers.tolist(), parts.tolist(), int(parts.max()), None

    def part_of(self, number: int) -> int:
        if self._by_number is None:
            self._by_number = dict(zip(self.numbers, self.parts, strict=True))
        return self._by_number.get(number, 0)


def best_of(lists: list[tuple[Postings, int]], top: int) -> list[tuple[int, int]]:
    """(score, document number) of the ``top`` best documents of a shard, score first, then number; walked document at a time.

    lists: a query's terms with their weights.
    """
    lists = sorted(((p, w) for p, w in lists if p.most), key=lambda x: x[0].most * x[1])
    most = np.cumsum([p.most * w for p, w in lists]).tolist()  # what a list and all lesser ones may add
    best: list[tuple[int, int]] = []  # (score, -number): the least is to go first
    lead = 0  # lists before this one only follow
    heap = [(p.numbers[0], i, 0) for i, (p, _) in enumerate(lists)]
    heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            _, i, at = heap[0]
            if i < lead:  # it has come to follow meanwhile
                heappop(heap)
                continue
            p, w = lists[i]
            score += w * p.parts[at]
            at += 1
            if at < len(p.numbers):
                heapreplace(heap, (p.numbers[at], i, at))
            else:
                heappop(heap)
        full = len(best) == top
        for i in range(lead - 1, -1, -1):
            if full and score + most[i] <= best[0][0]:  # of equal scores the one met first stays
                score = 0
                break
            score += lists[i][1] * lists[i][0].part_of(doc)
        if not score:
            continue
        if not full:
            heappush(best, (score, -doc))
        elif (score, -doc) > best[0]:
            heappushpop(best, (score, -doc))
        if len(best) == top:
            while lead < len(lists) and most[lead] <= best[0][0]:
                lead += 1
            if lead == len(lists):
                break
    return [(score, -doc) for score, doc in best]


def _searched(table: pa.Table, top: int, documents: int, total: int) -> Iterator[tuple]:
    """(item, score, doc_id) of the best documents of one shard for each query of a block."""
    names = table.column("term").to_pylist()
    blob = table.column("postings")[names.index(None)].as_py()
    n = len(blob) // 17
    idents, missing, lengths = np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "u1", n, 8 * n), np.frombuffer(blob, "<i8", n, 9 * n)
    sizes, back = np.unique(lengths, return_inverse=True)
    m = np.array([75 + 25 * int(x) * documents // total for x in sizes], np.int64)[back]
    asked = defaultdict(list)
    for i, name in enumerate(names):
        if name is not None:
            both = from_bytes(table.column("postings")[i].as_py()).reshape(-1, 2)
            at, tf = np.cumsum(both[:, 0]), both[:, 1]
            postings = Postings(at, SCALE * tf // (1000 * tf + 12 * m[at]))
            for item, weight in zip(*(table.column(c)[i].as_py() for c in ("items", "weights")), strict=True):
                asked[item].append((postings, weight))
    for item, lists in asked.items():
        for score, doc in best_of(lists, top):
            yield item, score, None if missing[doc] else int(idents[doc])


def _beside(large: DataFrame, small: DataFrame, size: int, on: list[str]) -> DataFrame:
    """A join with a table of so many bytes, broadcast if that is few."""
    return large.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on)


def search(shards: DataFrame, queries: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each query of ``queries`` (item_id, text) in an index."""
    documents, total = shards.where("term is null").agg(F.sum("docs"), F.sum("total")).first()
    kind = dict(queries.dtypes)["item_id"]
    result = f"item_id {kind}, rank int, doc_id long, score long"
    if not total:
        return queries.sparkSession.createDataFrame([], result)
    terms = cut(query_terms(queries))
    # queries get numbers, so that a block's postings carry small ones; a number also says the block
    items = cut(terms.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("mixed")))
    blocks = -(-items.count() // block)
    items = items.withColumn("block", F.pmod(F.xxhash64("mixed"), F.lit(max(1, blocks))).cast("int")).withColumnRenamed("mixed", "item")
    named = terms.join(items, terms.item_id.eqNullSafe(items.item_id)).select("block", "item", "term", "times")
    wanted = cut(named.select("term").distinct())
    postings = shards.where("term is not null")
    size = lambda df, value: int(df.agg(F.sum(value + F.octet_length("term") + 64)).first()[0] or 0)
    df = _beside(postings.select("term", "df"), wanted, size(wanted, F.lit(0)), ["term"]).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = named.join(df, "term").select("block", "term", "item", (weight * F.col("times")).alias("weight")).where("weight > 0")
    asked = cut(weighed.groupBy("block", "term").agg(F.collect_list("item").alias("items"), F.collect_list("weight").alias("weights")))
    # where it isn't broadcast, a frequent term's postings are dealt by salt
    asked_bytes = size(asked, 16 * F.size("items"))
    salts = 1 if asked_bytes <= BROADCAST_BYTES else SALTS
    spread = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lists = postings.select("shard", "term", "postings", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int").alias("salt"))
    met = _beside(lists, spread, asked_bytes, ["term", "salt"]).select("shard", "block", "term", "postings", "items", "weights")
    heads = shards.where("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))).alias("block"), "term", "postings")
    every = met.unionByName(heads, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        found = list(_searched(table, top, documents, total))
        return pa.table({n: pa.array([x[k] for x in found], pa.int64()) for k, n in enumerate(("item", "score", "doc_id"))})

    best = every.groupBy("shard", "block").applyInArrow(run, "item long, score long, doc_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(cut(index(docs)), benchmark)


ORACLE = {
    "op13_ranked_search": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT k, doc_id, size, term, count(*) AS tf FROM (SELECT k, doc_id, len(terms) AS size, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT item_id, k, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * s.n) // s.l)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 20"""
}
