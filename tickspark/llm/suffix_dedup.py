"""Removal of long byte strings that occur more than once, by deep-shallow sorting of sampled suffixes.

A string of ``length`` bytes is repeated if it starts anywhere else, in any document. Each such string is named by one of
its places, the anchor: where a 100-byte hash is least in it. Equal strings have their anchor at the same place, so only
anchors of equal hash need comparing, and about one byte in 150 is one.

1. Anchor hashes are counted over the corpus by packed exchange; anchors met once leave.
2. The texts around the others are dealt to buckets by hash. There the suffixes that start at the anchors are sorted, and
   so are the reversed prefixes that end there: a multikey sort on 8-byte characters down to a shallow depth, then a
   blind trie for each group that still shares all of it. Neighbours' common lengths then tell which strings are equal on
   both sides of their anchors.
3. Each document removes what its repeated strings cover.

Anchors of one hash in more than ``hot`` places (a passage that a large part of the corpus shares) don't fit one bucket:
their strings are counted by packed exchange under two independent 63-bit hashes of all ``length`` bytes, and are repeated
if both were met more than once.

Beside what goes, a document's words in passages of ``words`` or more words that another document holds are counted: by the
bytes of its words, whatever blanks lie between them. Such a passage may have fewer than ``length`` bytes, and then stays. A
run of so many words is named by the least hash of its eight-word grams; grams are counted by document in the exchange of the
anchors, and under those of several documents 63-bit hashes of the whole runs in a second one.

Edge cases: null and empty texts, and texts shorter than ``length``, keep all; rows that repeat an identifier are each a
document, judged by place, so that equal rows are repeats of each other; overlapping and periodic repeats count; an empty
table gives no rows; a very long text is cut whole, in a block of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm import exchange
from tickspark.llm.text import OTHER_CODE, SHINGLE_WORD, bounded_batches, gram_hash, mix, prefix_hash, raw, slices, span_hash, text_bytes, word_spans

LENGTH = 400
GRAM = 100
#: Depths in 8-byte characters to which the multikey sort goes before the blind tries.
SHALLOW_RIGHT, SHALLOW_LEFT = 18, 4
HOT = 8192
#: Words of a passage that is looked for in other documents, and of the grams that name it.
WORDS, WORD_GRAM = 51, 8

CONTEXTS = "bucket int, key long, least int, most int, before binary, after binary, rows binary, places binary"
#: Kinds of keys in the two exchanges: least grams of passages, and whole runs of words (0 to 2 are those of bytes).
PASSAGES, RUNS = 3, 4
MARKS = "block int, row long, start int, stop int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept binary"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: (first row, last row, running hash, anchors, their keys, and the first and last string start
    that each names). Positions count from the slice's first byte."""
    width = length - gram + 1
    for lo, hi in slices(offsets):
        base = offsets[lo]
        part = data[base : offsets[hi]]
        cuts = offsets[lo : hi + 1] - base
        if len(part) < length:
            continue
        running = prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        hashes = span_hash(running, at, at + gram)
        bits = max(1, len(part).bit_length())
        value = (hashes >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
        fits = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a >= length] or [np.zeros(0, np.int64)])
        if not len(fits):
            continue
        chosen = (sliding_min(value, width)[fits] & np.uint64((1 << bits) - 1)).astype(np.int64)
        turn = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        stop = np.concatenate([turn[1:], [len(fits)]]) - 1
        yield lo, hi, running, chosen[turn], hashes[chosen[turn]], fits[turn], fits[stop]


def sliding_min(value: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``, by prefix and suffix minima of blocks."""
    n = len(value) - width + 1
    blocks = -(-len(value) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    square = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(square, axis=1).reshape(-1)
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def passages(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: (each word's row, first words of all runs of ``words`` words, hashes of all grams, least gram of each run)."""
    for lo, hi in slices(offsets):
        part, cuts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, row = word_spans(part, cuts, SHINGLE_WORD)
        if len(starts) < words:
            continue
        at = np.flatnonzero(row[: len(row) - words + 1] == row[words - 1 :])
        if not len(at):
            continue
        grams = gram_hash(span_hash(prefix_hash(part), starts, ends), WORD_GRAM)
        yield lo + row, at, grams, sliding_min(grams, words - WORD_GRAM + 1)[at]


def run_hashes(grams: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """63-bit hashes of the runs of ``words`` words, by grams that cover them."""
    out = np.full(len(at), words, np.uint64)
    for i in [*range(0, words - WORD_GRAM, WORD_GRAM), words - WORD_GRAM]:
        out = mix(out + grams[at + i])
    return out >> np.uint64(1)


def rows_of_keys(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and how many rows hold each."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return np.unique(keys[fresh], return_counts=True)


def multikey_sort(group: np.ndarray, digits: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group in that order) by group, then by ``depth`` 8-byte characters. Groups of one row take no further part."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    for d in range(depth):
        size = np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        own, key = group[tied], digits[order[tied], d]
        inner = np.lexsort((key, own))
        order[tied] = order[tied][inner]
        own, key = own[inner], key[inner]
        changed = np.zeros(len(group), bool)
        changed[1:] = group[1:] != group[:-1]
        changed[tied[1:]] |= (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        group = np.cumsum(changed)
    return order, group


class BlindTrie:
    """Orders texts that share a long beginning: only branching bytes are looked at on the way down, then one comparison
    with the text reached tells where a new one belongs."""

    def __init__(self, texts: np.ndarray):
        self.texts, self.root = texts, None

    def common(self, i: int, j: int) -> int:
        differs = self.texts[i] != self.texts[j]
        at = int(differs.argmax())
        return at if differs[at] else len(differs)

    def insert(self, i: int) -> None:
        """A leaf is (None, [equal rows]); an inner node (depth, {byte: node}, a row below it)."""
        if self.root is None:
            self.root = (None, [i])
            return
        node, row = self.root, self.texts[i]
        while node[0] is not None:
            node = node[1].get(int(row[node[0]])) or (None, [node[2]])
        near = node[1][0]
        depth = self.common(i, near)
        if depth == len(row):
            node[1].append(i)
            return
        parent, edge, node = None, 0, self.root
        while node[0] is not None and node[0] < depth:
            parent, edge = node, int(row[node[0]])
            node = node[1][edge]
        if node[0] == depth:
            node[1][int(row[depth])] = (None, [i])
            return
        inner = (depth, {int(row[depth]): (None, [i]), int(self.texts[near][depth]): node}, near)
        if parent is None:
            self.root = inner
        else:
            parent[1][edge] = inner

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(group: np.ndarray, texts: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows by group, then by text; and how many bytes each shares with the row before it, -1 at a
    group's first. ``texts`` is a matrix of bytes, its width a multiple of 8."""
    digits = texts.view(">u8")
    order, tied = multikey_sort(group, digits, min(shallow, digits.shape[1]))
    common = neighbours(texts, order)
    starts = np.flatnonzero(np.concatenate([[True], tied[1:] != tied[:-1], [True]]))
    mixed = np.zeros(len(order), bool)
    mixed[1:] = (tied[1:] == tied[:-1]) & (common[1:] < texts.shape[1])
    some = np.add.reduceat(mixed, starts[:-1]) if len(order) else np.zeros(0)
    for g in np.flatnonzero(some):
        a, b = starts[g], starts[g + 1]
        if b - a > 1:
            trie = BlindTrie(texts)
            for i in order[a:b].tolist():
                trie.insert(i)
            order[a:b] = trie.ordered()
    common = neighbours(texts, order)
    own = group[order]
    common[np.concatenate([[True], own[1:] != own[:-1]])] = -1
    return order, common


def neighbours(texts: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 4096):
        b = min(a + 4096, len(order))
        differs = texts[order[a:b]] != texts[order[a - 1 : b - 1]]
        at = differs.argmax(axis=1)
        out[a:b] = np.where(differs[np.arange(b - a), at], at, texts.shape[1])
    return out


def repeated(key: np.ndarray, least: np.ndarray, most: np.ndarray, weight: np.ndarray, before: np.ndarray, after: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, rows): the rows whose string that starts ``offset`` bytes before the anchor occurs more than once.

    before: bytes before the anchor, nearest first; after: bytes from the anchor on; both bytes are plus one, 0 where none.
    """
    _, group = np.unique(key, return_inverse=True)
    right, shared_right = deep_shallow(group, after, SHALLOW_RIGHT)
    left, shared_left = deep_shallow(group, before, SHALLOW_LEFT)
    n = len(key)
    class_right, class_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for offset in range(int(least.min()), int(most.max()) + 1):
        active = np.flatnonzero((least <= offset) & (offset <= most))
        if not len(active):
            continue
        class_right[right] = np.cumsum(shared_right < length - offset)
        class_left[left] = np.cumsum(shared_left < max(offset, 0))
        code = class_right[active] * (n + 1) + class_left[active]
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        many = np.add.reduceat(weight[active[order]], first) > 1
        yield offset, active[order[np.repeat(many, np.diff(np.concatenate([first, [len(code)]])))]]


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Bytes plus one (no UTF-8 byte is 255), 0 behind the end; the width is rounded up to 8-byte characters."""
    out = np.zeros((len(blobs), -(-width // 8) * 8), np.uint8)
    lengths = np.array([len(b) for b in blobs])
    inside = np.arange(out.shape[1])[None] < lengths[:, None]
    out[inside] = np.frombuffer(b"".join(blobs), np.uint8) + 1
    return out


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals of each row, sorted."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    far = stop.astype(np.int64) + np.unique(row, return_inverse=True)[1] * (1 << 40)  # rows lie apart, so that one running maximum serves all
    reach = np.maximum.accumulate(far)
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] + (far - stop)[1:] > reach[:-1])])
    first = np.flatnonzero(fresh)
    return row[first], start[first], np.maximum.reduceat(stop, first)


def _hot_strings(part: np.ndarray, running: np.ndarray, first: np.ndarray, last: np.ndarray, chosen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and two 63-bit hashes of all strings that the chosen anchors name."""
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[chosen], last[chosen], strict=True)])
    return starts, *(span_hash(r, starts, starts + length) >> np.uint64(1) for r in (running, prefix_hash(part, OTHER_CODE)))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = 4 << 20, hot: int = HOT, words: int = WORDS) -> DataFrame:
    """RESULT of every row: bytes, removed bytes, maximal removed runs, words in passages of other documents, and the bytes that stay."""
    bounded_batches(docs.sparkSession)
    n_bytes = text_bytes(docs)
    blocks, buckets = exchange.block_counts(n_bytes, block_bytes)
    bits = exchange.key_bits(n_bytes)
    shift = np.uint64(64 - bits)
    # a row is named within its block by the order of identifier and text: the same whenever the block is computed
    texts = exchange.by_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), blocks).groupBy("block")

    def opened(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return table, *raw(table.column("text"))

    def block_keys(found: list[tuple]) -> np.ndarray:
        return np.concatenate([k for *_, k, _, _ in found] or [np.zeros(0, np.uint64)]) >> shift

    def known(answers: pa.Table, found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(block_keys(found))
        return keys, exchange.answered(answers, 0, keys, buckets, bits)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, data, offsets = opened(table)
        keys = block_keys(list(anchors(data, offsets, length, gram)))
        named = []
        for row, at, _, least in passages(data, offsets, words):
            turn = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[at[1:]] != row[at[:-1]])]))
            named.append((least[turn] >> shift, row[at[turn]]))
        return exchange.requests(key[0].as_py(), {0: np.unique(keys, return_counts=True), PASSAGES: rows_of_keys(*joined(named))}, buckets, bits)

    def joined(pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([k for k, _ in pairs] or [np.zeros(0, np.uint64)]), np.concatenate([r for _, r in pairs] or [np.zeros(0, np.int64)])

    def shared(told: pa.Table, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(each word's row, first words and hashes of the runs whose least gram several documents hold)."""
        found = list(passages(data, offsets, words))
        keys = np.unique(np.concatenate([least for *_, least in found] or [np.zeros(0, np.uint64)]) >> shift)
        several = exchange.answered(told, PASSAGES, keys, buckets, bits) > 1
        for row, at, grams, least in found:
            at = at[several[np.searchsorted(keys, least >> shift)]]
            yield row, at, run_hashes(grams, at, words)

    answers = exchange.totals(texts.applyInArrow(ask, exchange.REQUEST))

    def contexts(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        _, data, offsets = opened(table)
        placed = list(anchors(data, offsets, length, gram))
        keys, totals = known(told, placed)
        found: dict[tuple, list[tuple[int, int]]] = {}
        for lo, hi, _, at, hashes, first, last in placed:
            base = offsets[lo]
            total = totals[np.searchsorted(keys, hashes >> shift)]
            part = data[base : offsets[hi]].tobytes()
            row = np.searchsorted(offsets[lo : hi + 1] - base, at, side="right") - 1
            for i in np.flatnonzero((total > 1) & (total <= hot)).tolist():
                a, s, e = int(at[i]), int(first[i]), int(last[i])
                named = (int(hashes[i].view(np.int64)), a - e, a - s, part[s:a][::-1], part[a : e + length])
                found.setdefault(named, []).append((lo + int(row[i]), int(a - (offsets[lo + row[i]] - base))))
        block = key[0].as_py()
        names = list(found)
        rows = [np.array([(block << 32) | r for r, _ in v], np.int64).tobytes() for v in found.values()]
        places = [np.array([p for _, p in v], np.int64).tobytes() for v in found.values()]
        return pa.table({"bucket": pa.array([n[0] % buckets for n in names], pa.int32()), **{c: pa.array([n[k] for n in names], t) for k, (c, t) in enumerate((("key", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("before", pa.binary()), ("after", pa.binary())))}, "rows": pa.array(rows, pa.binary()), "places": pa.array(places, pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        least, most, key = (np.asarray(table.column(c)) for c in ("least", "most", "key"))
        held = [np.frombuffer(b, np.int64) for b in table.column("rows").to_pylist()]
        places = [np.frombuffer(b, np.int64) for b in table.column("places").to_pylist()]
        weight = np.array([len(h) for h in held], np.int64)
        begin = np.full(len(key), -1, np.int64)  # of a member's current run of repeated offsets
        past = np.full(len(key), -2, np.int64)
        runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        before, after = matrix(table.column("before").to_pylist(), int(most.max(initial=0))), matrix(table.column("after").to_pylist(), length)
        for offset, rows in repeated(key, least, most, weight, before, after, length) if len(key) else ():
            new = rows[past[rows] != offset - 1]
            done = new[begin[new] >= 0]
            runs.append((done, begin[done].copy(), past[done].copy()))
            begin[new] = offset
            past[rows] = offset
        done = np.flatnonzero(begin >= 0)
        runs.append((done, begin[done], past[done]))
        member, low, high = (np.concatenate([r[k] for r in runs]) for k in range(3))
        # strings that start at anchor - high .. anchor - low cover anchor - high .. anchor - low + length
        row = np.concatenate([held[m] for m in member] or [np.zeros(0, np.int64)])
        many = weight[member]
        place = np.concatenate([places[m] for m in member] or [np.zeros(0, np.int64)])
        row, start, stop = merged(row, place - np.repeat(high, many), place - np.repeat(low, many) + length)
        return pa.table({"block": pa.array((row >> 32).astype(np.int32)), "row": pa.array(row & 0xFFFFFFFF), "start": pa.array(start.astype(np.int32)), "stop": pa.array(stop.astype(np.int32))})

    marks = texts.cogroup(answers.groupBy("block")).applyInArrow(contexts, CONTEXTS).groupBy("bucket").applyInArrow(compare, MARKS)

    def ask_hot(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        _, data, offsets = opened(table)
        placed = list(anchors(data, offsets, length, gram))
        keys, totals = known(told, placed)
        kinds = {}
        if (totals > hot).any():
            strings = [_hot_strings(data[offsets[lo] : offsets[hi]], running, first, last, np.flatnonzero(totals[np.searchsorted(keys, hashes >> shift)] > hot), length) for lo, hi, running, _, hashes, first, last in placed]
            kinds = {kind: np.unique(np.concatenate([s[kind] for s in strings]), return_counts=True) for kind in (1, 2)}
        kinds[RUNS] = rows_of_keys(*joined([(runs, row[at]) for row, at, runs in shared(told, data, offsets)]))
        return exchange.requests(key[0].as_py(), kinds, buckets, 63)

    hot_answers = exchange.totals(texts.cogroup(answers.groupBy("block")).applyInArrow(ask_hot, exchange.REQUEST), summed=lambda t: np.minimum(t, np.uint64(2)))

    def remove(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        table, data, offsets = opened(table)
        kinds = np.asarray(told.column("kind").fill_null(-1)) if told.num_rows else np.zeros(0, np.int32)
        found = [tuple(np.asarray(told.filter(pa.array(kinds == -1)).column(c)).astype(np.int64) for c in ("row", "start", "stop"))] if (kinds == -1).any() else []
        if np.isin(kinds, (1, 2)).any():
            placed = list(anchors(data, offsets, length, gram))
            keys, totals = known(told, placed)
            pieces = []
            for lo, hi, running, _, hashes, first, last in placed:
                chosen = np.flatnonzero(totals[np.searchsorted(keys, hashes >> shift)] > hot)
                pieces.append((lo, hi, *_hot_strings(data[offsets[lo] : offsets[hi]], running, first, last, chosen, length)))
            names = {kind: np.unique(np.concatenate([p[2 + kind] for p in pieces])) for kind in (1, 2)}
            often = {kind: exchange.answered(told, kind, names[kind], buckets, 63) > 1 for kind in (1, 2)}
            for lo, hi, starts, *strings in pieces:
                starts = starts[np.logical_and(*(often[k][np.searchsorted(names[k], s)] for k, s in zip((1, 2), strings, strict=True)))]
                row = np.searchsorted(offsets[lo : hi + 1] - offsets[lo], starts, side="right") - 1
                start = starts - (offsets[lo + row] - offsets[lo])
                found.append((lo + row, start, start + length))
        row, start, stop = merged(*(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3)))
        edges = np.searchsorted(row, np.arange(table.num_rows + 1))
        held = np.zeros(table.num_rows, np.int64)
        if (kinds == RUNS).any():
            pieces = list(shared(told, data, offsets))
            names = np.unique(np.concatenate([runs for *_, runs in pieces]))
            elsewhere = exchange.answered(told, RUNS, names, buckets, 63) > 1
            for word_row, at, runs in pieces:
                at = at[elsewhere[np.searchsorted(names, runs)]]
                depth = np.zeros(len(word_row) + 1, np.int64)
                depth[at] += 1
                depth[at + words] -= 1
                held += np.bincount(word_row[np.cumsum(depth[:-1]) > 0], minlength=table.num_rows)
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "n_passage_words": [], "kept": []}
        for i in range(table.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            a, b = edges[i], edges[i + 1]
            kept = [text[p:q].tobytes() for p, q in zip(np.concatenate([[0], stop[a:b]]), np.concatenate([start[a:b], [len(text)]]), strict=True)]
            for name, value in (("n_bytes", len(text)), ("n_removed", int((stop[a:b] - start[a:b]).sum())), ("n_spans", int(b - a)), ("n_passage_words", int(held[i])), ("kept", b"".join(kept))):
                out[name].append(value)
        return pa.table({"doc_id": table.column("doc_id"), **{n: pa.array(v, pa.binary() if n == "kept" else pa.int64()) for n, v in out.items()}})

    told = answers.unionByName(hot_answers).unionByName(marks, allowMissingColumns=True)
    return texts.cogroup(told.groupBy("block")).applyInArrow(remove, RESULT)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("removed"), "n_passage_words")
