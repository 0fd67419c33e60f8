"""Corpus-wide counts of hashed keys, exchanged in packed blocks.

Documents are dealt to blocks by hash. A block sends its distinct keys, sorted and delta-coded, to the buckets that
partition the key space; a bucket sums the counts of all blocks and answers each block in the order of its request.
Rows between stages are (bucket, block, blob), so a hundred million keys move as some thousand rows and a hot key costs
a block one entry. All sizes are bounded by ``block_bytes``; the number of blocks and buckets grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST = "bucket int, block int, kind int, keys binary, counts binary"
ANSWER = "block int, kind int, bucket int, counts binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, low plane first; as many planes as the largest needs."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(blob, np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return len(keys).to_bytes(4, "little") + pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.cumsum(unpack(blob[4:], n), dtype=np.uint64)


def key_bits(n_bytes: int, more: int = 14) -> int:
    """Bits of a key: ``more`` than number the text's bytes, so that a key meets another by chance once in 2**more at any size."""
    return min(63, max(1, n_bytes).bit_length() + more)


def by_block(docs: DataFrame, blocks: int) -> DataFrame:
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))


def block_counts(n_bytes: int, block_bytes: int = 4 << 20) -> tuple[int, int]:
    """(blocks, buckets) for so much text."""
    blocks = max(1, -(-n_bytes // block_bytes))
    return blocks, max(1, -(-blocks // 2))


def requests(block: int, kinds: dict[int, tuple[np.ndarray, np.ndarray]], buckets: int, bits: int) -> pa.Table:
    """Rows of REQUEST for the sorted distinct keys and counts of each kind."""
    rows: dict[str, list] = {"bucket": [], "block": [], "kind": [], "keys": [], "counts": []}
    for kind, (keys, counts) in kinds.items():
        edges = np.searchsorted(keys, bucket_edges(buckets, bits))
        for bucket in np.flatnonzero(np.diff(edges)):
            at = slice(edges[bucket], edges[bucket + 1])
            for name, value in (("bucket", int(bucket)), ("block", block), ("kind", kind), ("keys", pack_sorted(keys[at])), ("counts", pack(counts[at]))):
                rows[name].append(value)
    return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "block": pa.array(rows["block"], pa.int32()), "kind": pa.array(rows["kind"], pa.int32()), "keys": pa.array(rows["keys"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})


def bucket_edges(buckets: int, bits: int) -> np.ndarray:
    return np.array([(b << bits) // buckets for b in range(buckets)] + [1 << bits], np.uint64)


def totals(asked: DataFrame, summed: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows of ANSWER: for each request the total counts over all blocks, in its order. summed: applied to the totals."""

    def reduce(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        blocks, bucket = np.asarray(table.column("block")), table.column("bucket")[0].as_py() if table.num_rows else 0
        out: dict[str, list] = {"block": [], "kind": [], "bucket": [], "counts": []}
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            keys = [unpack_sorted(table.column("keys")[int(i)].as_py()) for i in at]
            counts = [unpack(table.column("counts")[int(i)].as_py(), len(k)) for i, k in zip(at, keys, strict=True)]
            every = np.concatenate(keys)
            order = np.argsort(every, kind="stable")
            every, many = every[order], np.concatenate(counts)[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            distinct, total = every[first], np.add.reduceat(many, first)
            total = summed(total) if summed else total
            for i, k in zip(at, keys, strict=True):
                out["block"].append(int(blocks[i]))
                out["kind"].append(int(kind))
                out["bucket"].append(bucket)
                out["counts"].append(pack(total[np.searchsorted(distinct, k)]))
        return pa.table({"block": pa.array(out["block"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "counts": pa.array(out["counts"], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(reduce, ANSWER)


def answered(answers: pa.Table, kind: int, keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The totals of a block's own sorted distinct keys, from its rows of ANSWER."""
    edges = np.searchsorted(keys, bucket_edges(buckets, bits))
    out = np.zeros(len(keys), np.uint64)
    for k, bucket, blob in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True):
        if k == kind:
            out[edges[bucket] : edges[bucket + 1]] = unpack(blob, int(edges[bucket + 1] - edges[bucket]))
    return out
