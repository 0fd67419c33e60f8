"""Benchmark decontamination by one Aho-Corasick automaton.

Every window of 13 consecutive words of a benchmark item (all words of a shorter item) is a pattern over normalised text;
each document is normalised the same way, scanned once, and matches are mapped back to its words and to byte spans of the
original. The automaton is built once in each Python worker from a broadcast of the items, and is bounded: windows of up to
``max_pattern_bytes`` go into one, some 200 MB of memory as it stands. The items of a larger benchmark are dealt into parts with
an automaton each. A worker holds one of them at a time: it takes texts in groups of ``group_bytes``, scans a group with one
automaton after the other, and adds up what they find. The benchmark's text passes through the driver and is broadcast by
part.

Words: A-Z are lower-cased; letters, digits and all characters beyond ASCII belong to words, all else separates.

Edge cases: a null or empty text, or one without words, has no hits and is clean; an item without words has no window;
windows that several items share count for each of them; items that repeat an item_id are one item; matches may overlap
and each word counts once; repeated rows are judged each; a very long text is scanned whole, over a MiB alone in its slice;
an empty benchmark leaves all clean; an empty table gives no rows; other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.text import ALNUM_WORD, LOWER, bounded_batches, given_back, raw, set_aside, slices, word_spans

WINDOW = 13
#: A document is contaminated if at least this part of its words is hit (as 1 in SHARE).
SHARE = 20

#: Bytes to their normalised form; separators become a space.
NORMAL = bytes(LOWER[c] if ALNUM_WORD[c] else 32 for c in range(256))
SPAN = "struct<start:long,end:long,first:long,past:long>"
FIELDS = f"n_words long, n_hit long, items array<string>, spans array<{SPAN}>"

_automata: dict[str, object] = {}


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The item's windows in normalised form, each with a space before and after."""
    words = (text or "").encode().translate(NORMAL).split()
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))] if words else []


def automaton(windows: dict[bytes, tuple[int, list[str]]]):
    """Values are (words in the window, items). Bytes are held as Latin-1 text, a character each."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for pattern, value in windows.items():
        made.add_word(pattern.decode("latin-1"), value)
    made.make_automaton()
    return made


def scan(machine, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[str], list[dict]]]:
    """(n_words, n_hit, items, byte spans in the original) of each text, in one pass over it."""
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        cuts = offsets[lo : hi + 1] - offsets[lo]
        starts, ends, row = word_spans(part, cuts, ALNUM_WORD)
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            first, last = edges[i], edges[i + 1]
            begin, finish = starts[first:last], ends[first:last]
            if first == last:
                yield 0, 0, [], []
                continue
            normal = b" " + b" ".join(part[cuts[i] : cuts[i + 1]].tobytes().translate(NORMAL).split()) + b" "
            items: set[str] = set()
            found: list[tuple[int, int]] = []
            if len(machine):
                for at, (n, own) in machine.iter(normal.decode("latin-1")):
                    found.append((at, n))
                    items.update(own)
            if not found:
                yield len(begin), 0, [], []
                continue
            closing = np.cumsum(finish - begin + 1)  # of each word, the place of the space after it
            last_word = np.searchsorted(closing, [at for at, _ in found])
            deltas = np.zeros(len(begin) + 1, np.int64)
            np.add.at(deltas, last_word - [n for _, n in found] + 1, 1)
            np.add.at(deltas, last_word + 1, -1)
            hit = np.cumsum(deltas[:-1]) > 0
            turn = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            spans = [{"start": int(begin[s] - cuts[i]), "end": int(finish[e - 1] - cuts[i]), "first": int(s), "past": int(e)} for s, e in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]
            yield len(begin), int(hit.sum()), sorted(items), spans


def parts_of(benchmark: DataFrame, max_pattern_bytes: int, window: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in parts whose windows are of bounded size, read item by item."""
    part: list[tuple[str, str]] = []
    size = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = window * len((text or "").encode())
        if part and size + n > max_pattern_bytes:
            yield part
            part, size = [], 0
        part.append((item or "", text or ""))
        size += n
    yield part


def built(part: list[tuple[str, str]], window: int):
    """The automaton of a part's items."""
    windows: dict[bytes, tuple[int, list[str]]] = {}
    for item, text in part:
        for w in item_windows(text, window):
            windows.setdefault(w, (w.count(b" ") - 1, []))[1].append(item)
    return automaton(windows)


def united(a: list[dict], b: list[dict]) -> list[dict]:
    """The union of two lists of spans, sorted; spans that touch or overlap in words become one."""
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: (s["first"], s["past"])):
        if out and s["first"] <= out[-1]["past"]:
            out[-1] = out[-1] | {"end": max(out[-1]["end"], s["end"]), "past": max(out[-1]["past"], s["past"])}
        else:
            out.append(s)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, max_pattern_bytes: int = 4 << 20, group_bytes: int = 64 << 20) -> DataFrame:
    """``keep`` columns and FIELDS of every row: words, words hit, items met, and spans of hit bytes in the original."""
    bounded_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    names = [f"_k{i}" for i in range(len(keep))]
    df = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col("text").alias("_text"))
    schema = ", ".join([*(f"{n} {kinds[c]}" for c, n in zip(keep, names, strict=True)), FIELDS])
    shared = [docs.sparkSession.sparkContext.broadcast(part) for part in parts_of(benchmark, max_pattern_bytes, window)]
    key = uuid.uuid4().hex
    types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "first", "past")])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches, group_bytes if len(shared) > 1 else 0):
            found: list[list | None] = [None] * len(group)
            # the automaton that is held goes first, so that each group builds one less
            for i in sorted(range(len(shared)), key=lambda i: (key, i) not in _automata):
                if (key, i) not in _automata:
                    _automata.clear()
                    _automata[key, i] = built(shared[i].value, window)
                for j, b in enumerate(group):
                    rows = list(scan(_automata[key, i], *raw(b.column("_text"))))
                    found[j] = rows if found[j] is None else [both(x, y) for x, y in zip(found[j], rows, strict=True)]
            for b, rows in zip(group, found, strict=True):
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.record_batch([b.column(c) for c in names] + made, [*names, "n_words", "n_hit", "items", "spans"])

    found = df.mapInArrow(run, schema)
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "n_words", "n_hit", "items", "spans")


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of so many bytes, or a batch more than that."""
    group: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        group.append(b)
        held += b.nbytes
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def both(x: tuple, y: tuple) -> tuple:
    """What two automata have found in one text."""
    spans = united(x[3], y[3])
    return x[0], sum(s["past"] - s["first"] for s in spans), sorted({*x[2], *y[2]}), spans


def contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    aside, names = set_aside(docs, "text")
    return given_back(hits(aside, benchmark, keep=tuple(names)).where(~contaminated()), names, docs.columns)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = hits(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = {
    "op8_decontaminate": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)),
m AS (SELECT doc_id, i, g.n, item_id FROM g JOIN p ON g.win = p.win AND g.n = p.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
