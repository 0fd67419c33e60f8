"""Hashed n-gram features of whole texts, and bounded training samples for the linear classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.text import LOWER, SHINGLE_WORD, bounded_batches, prefix_hash, raw, slices, span_hash, word_spans

#: Fixed multipliers, one for each order of character n-grams (any large odd numbers).
SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint32)

#: Up to so many label values are sampled by a sort of their own each, more of them by one window.
FEW = 8

Extract = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


def remainder(ident: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, by a modulus: the fold that decides which labels may be learnt from."""
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def char_grams(part: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A feature number for the n-gram of bytes that starts at each byte (the last ``order`` - 1 run over the end and are to be cut)."""
    code = np.zeros(len(part), np.uint32)
    for i in range(order):
        code[: max(0, len(part) - i)] += part[i:].astype(np.uint32) * SEEDS[i]
        code = (code ^ (code >> np.uint32(15))) * SEEDS[(i + order) % 8] if i + 1 < order else code
    code ^= code >> np.uint32(13)
    return (code * SEEDS[order % 8]) >> np.uint32(32 - bits)


def shape_grams(part: np.ndarray, cuts: np.ndarray, bits: int, most: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, row) of n-grams of word shapes: the case of a word, what it ends in, and whether it repeats the word before."""
    starts, ends, row = word_spans(part, cuts, SHINGLE_WORD)
    if not len(starts):
        return []
    words = span_hash(prefix_hash(part), starts, ends)
    first, last = part[starts], part[ends - 1]
    upper = lambda c: ((c >= 65) & (c <= 90)).astype(np.uint64)
    lower = lambda c: ((c >= 97) & (c <= 122) | (c >= 128)).astype(np.uint64)
    second = part[np.minimum(starts + 1, ends - 1)]
    repeated = np.zeros(len(words), np.uint64)
    repeated[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    ending = np.where(lower(last) + upper(last) > 0, 0, last).astype(np.uint64)
    shape = upper(first) + 2 * lower(first) + 4 * upper(second) + 8 * lower(second) + 16 * repeated + 32 * ending
    out = []
    for order in range(1, most + 1):
        n = len(shape) - order + 1
        if n <= 0:
            break
        code = np.full(n, order, np.uint64)
        for i in range(order):
            code = (code + shape[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(31)
        whole = row[:n] == row[order - 1 :]
        out.append(((code[whole] >> np.uint64(64 - bits)).astype(np.uint32), row[:n][whole]))
    return out


def distinct(codes: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """The distinct feature numbers, in any order, in linear time; scratch is as long as the feature space."""
    order = np.arange(len(codes), dtype=np.int32)
    scratch[codes] = order
    return codes[scratch[codes] == order]


def indicators(orders: tuple[int, ...], bits: int, shapes: bool, lower: bool) -> Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]:
    """A function from (bytes, offsets) to the distinct features of each row's whole text."""
    scratch = np.zeros(1 << bits, np.int32)

    def of(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        for lo, hi in slices(offsets):
            cuts = offsets[lo : hi + 1] - offsets[lo]
            part = data[offsets[lo] : offsets[hi]]
            if lower:
                part = LOWER[part]
            kinds = [(char_grams(part, n, bits), n) for n in orders]
            worded = []
            for codes, row in shape_grams(part, cuts, bits) if shapes else []:
                worded.append((codes, np.searchsorted(row, np.arange(hi - lo + 1))))
            for i in range(hi - lo):
                found = [codes[cuts[i] : max(cuts[i], cuts[i + 1] - n + 1)] for codes, n in kinds]
                found += [codes[edges[i] : edges[i + 1]] for codes, edges in worded]
                yield distinct(np.concatenate(found), scratch)

    return of


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sampled(labelled: DataFrame, docs: DataFrame, label: str, per_class: int, total: int | None = None, least: int = 1, longest: int = 1 << 15) -> DataFrame:
    """(doc_id, label, text): of each label value up to ``per_class`` rows, those whose identifiers hash lowest. Texts of more
    than ``longest`` bytes are left out, so that the sample is bounded in bytes as well.

    ``labelled`` has (doc_id, label), one row for each identifier. Every label value is learnt from. If there are so many that
    the sample would pass ``total`` rows, each gets an equal part of them, but ``least`` rows at the least. The chosen
    identifiers are thus bounded, so they are broadcast.
    """
    labelled = labelled.where(F.col(label).isNotNull()).select("doc_id", label)
    values = sorted(r[0] for r in labelled.select(label).distinct().collect())
    if not values:
        return docs.select("doc_id", "text").withColumn(label, F.lit(None).cast(dict(labelled.dtypes)[label])).limit(0)
    if total is not None:
        per_class = min(per_class, max(least, total // len(values)))
    if len(values) > FEW:
        place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id"))
        chosen = labelled.withColumn("place", place).where(F.col("place") <= per_class).drop("place")
    else:
        parts = [labelled.where(F.col(label) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in values]
        chosen = parts[0]
        for p in parts[1:]:
            chosen = chosen.unionByName(p)
    return docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(F.broadcast(chosen), "doc_id")


def collected(rows: DataFrame, label: str, make: Callable) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and features of a bounded sample, on the driver, in the order of identifiers."""
    bounded_batches(rows.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            data, offsets = raw(b.column("text"))
            codes = [c.astype("<u4").tobytes() for c in of(data, offsets)]
            yield pa.record_batch({"doc_id": b.column("doc_id"), label: b.column(label), "codes": pa.array(codes, pa.binary())})

    kind = dict(rows.dtypes)
    got = rows.select("doc_id", label, "text").mapInArrow(extract, f"doc_id {kind['doc_id']}, {label} {kind[label]}, codes binary").toArrow().sort_by("doc_id")
    return np.array(got.column(label).to_pylist()), [np.frombuffer(c.as_buffer(), "<u4") for c in got.column("codes")]


def scored(docs: DataFrame, make: Callable, weigh: Callable, fields: str, keep: tuple[str, ...]) -> DataFrame:
    """Maps every text to ``fields`` by ``weigh(features of each row) -> dict of columns``; ``keep`` columns stay, in front, also
    where they are named as a field is."""
    bounded_batches(docs.sparkSession)
    names = [f.split()[0] for f in fields.split(",")]
    kept = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            if b.num_rows:
                out = weigh(of, *raw(b.column("_text")))
                yield pa.record_batch([b.column(c) for c in kept] + [pa.array(out[n]) for n in names], [*kept, *names])

    kinds = dict(docs.dtypes)
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept, strict=True)), F.col("text").alias("_text"))
    return rows.mapInArrow(run, ", ".join([*(f"{n} {kinds[c]}" for c, n in zip(keep, kept, strict=True)), fields])).toDF(*keep, *names)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(margins: np.ndarray, positive: np.ndarray, prior: float, steps: int = 40) -> tuple[float, float]:
    """Slope and intercept of P(positive | margin) = logistic(slope * margin + intercept), for classes of prior ``prior``.

    Newton steps on smoothed targets (within 0.01 of 0 and 1, nearer in large samples) with a small ridge; the sample's class shares are replaced by the prior afterwards.
    """
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, 1 - min(0.01, 1 / (n1 + 2)), min(0.01, 1 / (n0 + 2)))
    weight = np.where(positive, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(margins)
    x = np.column_stack([margins, np.ones(len(margins))])
    theta = np.zeros(2)
    for _ in range(steps):
        p = logistic(x @ theta)
        grad = x.T @ (weight * (p - target)) + 1e-3 * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    return float(theta[0]), float(theta[1] + np.log(prior / (1 - prior)))
