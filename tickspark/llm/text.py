"""Byte-level text helpers of the corpus operators: numpy on the buffers of Arrow text columns.

Everything here works on one Arrow batch or one bounded block inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that end a word for the five-word shingles, and the word bytes of the contamination rule.
SPACES = b" \t\n\r\x0b\x0c"
SHINGLE_WORD = np.array([c not in SPACES for c in range(256)])
ALNUM_WORD = np.array([c >= 0x80 or bytes([c]).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
#: For a second hash of the same bytes, independent of the first one.
OTHER_CODE = mix(np.arange(257, 513, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("pow", _MULTIPLIER), ("inv", pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["pow"][:n], _tables["inv"][:n]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes together (a longer text stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(part: np.ndarray, cuts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word in ``part``; rows are cut at ``cuts`` (first 0, last the length)."""
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[part]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(part))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(cuts, starts, side="right") - 1


def prefix_hash(part: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Running polynomial hash of bytes, for ``span_hash``."""
    out = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(code[part] * _powers(len(part))[0], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    inverse = _powers(len(running))[1]
    return mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hash(words: np.ndarray, order: int) -> np.ndarray:
    """Hashes of all runs of ``order`` consecutive word hashes."""
    n = max(0, len(words) - order + 1)
    out = np.full(n, order, np.uint64)
    for i in range(order):
        out = (out ^ words[i : i + n]) * np.uint64(_MULTIPLIER)
        out ^= out >> np.uint64(29)
    return mix(out)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Small Arrow batches, so that a Python worker holds some MB of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """All columns under neutral names besides those ``used`` (as they are), so that no column clashes with a computed one."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), *used), names


def given_back(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in all rows (one scan with a partial sum)."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
