"""Random trades from a semi-Markov chain of the states CANCEL, LONG and SHORT.

A row maps the state before it to the next one, and a state to the time for which it is held. Maps compose, so a slice of a
stream is summed up by where it leads from each of the three states, and how long that takes; what a slice starts from is
carried over one row for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickspark.functions.timeunits import duration
from tickspark.operators import slices

STATES = ("CANCEL", "LONG", "SHORT")


def mean_of_rate(rate: str) -> float:
    """The mean time in seconds between events of a rate such as 5/h or 0.2/m."""
    n, _, unit = rate.partition("/")
    return duration(f"1{unit}") / 1e9 / float(n)


def onward_shares(fl: float = 1, fs: float = 1, lf: float = 1, ls: float = 1, sf: float = 1, sl: float = 1) -> tuple[float, float, float]:
    """The share of each state's turns that go to the next one, from the rates between flat, long and short."""
    return fl / (fl + fs), ls / (lf + ls), sf / (sf + sl)


def draw(seed: int, name: str) -> Column:
    """A number from 0 to below 1 for each ``id``, the same wherever the row is computed: 52 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col("id").cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def gentrades(spark: SparkSession, n: int, means: tuple[float, float, float] = (60.0, 60.0, 60.0), onward: tuple[float, float, float] = (0.5, 0.5, 0.5), seed: int = 1, streams: int = 1) -> DataFrame:
    """``trades`` for ``n`` numbers of each of so many streams."""
    return trades(spark.range(n * streams).select((F.col("id") % streams).alias("stream"), "id"), means, onward, seed)


def led_to(onward: np.ndarray) -> np.ndarray:
    """Of each row's map (a state for each of the three before it) the map of all rows before: (rows + 1, 3), by doubling."""
    maps, reach = np.concatenate([[[0, 1, 2]], onward]), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


def trades(drawn: DataFrame, means: tuple[float, float, float] = (60.0, 60.0, 60.0), onward: tuple[float, float, float] = (0.5, 0.5, 0.5), seed: int = 1, rows: int = slices.ROWS) -> DataFrame:
    """stream, seq, t, side: a trade for each row (stream, id) of a table, those of a stream by number, starting at 0. A state is
    held for an exponential time of its mean (seconds, cut to milliseconds); with its share of ``onward`` the next state in the cycle follows, else the one after
    (``onward_shares`` has them from six rates). Streams are reproducible from the seed, however they are cut into slices of
    some ``rows``."""
    dice = drawn.select("stream", F.col("id").alias("seq"), F.col("id").alias("t"), (-F.log(1 - draw(seed, "wait"))).alias("w"), draw(seed, "turn").alias("v"))
    cut, single = slices.sliced(dice, ["stream"], rows)
    keys, order = ["stream", "_slice"], ("seq",)
    kinds = dict(cut.dtypes)
    key_schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    sum_schema = f"{key_schema}, to array<long>, took array<long>"
    types = to_arrow_schema(StructType.fromDDL(sum_schema))

    def moves(b: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows before each row and before the end lead, and for how long a row holds each state."""
        w, v = (np.asarray(b.column(c)[lo:hi])[:, None] for c in ("w", "v"))
        held = (w * np.array(means) * 1000).astype(np.int64) * 10**6
        return led_to((np.arange(3) + np.where(v < np.array(onward), 1, 2)) % 3), held

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, to, took = None, np.arange(3), np.zeros(3, np.int64)
        made = lambda: pa.RecordBatch.from_pydict({n: [x] for n, x in zip(types.names, (*own, to.tolist(), took.tolist()), strict=True)}, schema=types)
        for b in batches:
            for lo, hi in slices.segments(b, keys):
                key = slices.key_of(b, keys, lo)
                if key != own:
                    if own is not None:
                        yield made()
                    own, to, took = key, np.arange(3), np.zeros(3, np.int64)
                maps, held = moves(b, lo, hi)
                took = took + np.take_along_axis(held, maps[:-1], axis=1).sum(axis=0)[to]
                to = maps[-1][to]
        if own is not None:
            yield made()

    def carry(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice")
        state, t, starts = 0, 0, []
        for to, took in zip(table.column("to").to_pylist(), table.column("took").to_pylist(), strict=True):
            starts.append((state, t))
            state, t = to[state], t + took[state]
        return pa.table([*(table.column(k) for k in keys), *(pa.array([x[i] for x in starts], pa.int64()) for i in range(2))], [*keys, "from_state", "from_t"])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, t = None, 0, 0
        for b in batches:
            states, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in slices.segments(b, keys):
                key = slices.key_of(b, keys, lo)
                if key != own:
                    own, (state, t) = key, slices.key_of(b, ["from_state", "from_t"], lo)
                maps, held = moves(b, lo, hi)
                states.append(maps[:-1, state])
                ends = t + np.cumsum(np.take_along_axis(held, states[-1][:, None], axis=1)[:, 0])
                times.append(np.concatenate([[t], ends[:-1]]))
                state, t = int(maps[-1, state]), int(ends[-1])
            yield pa.record_batch([b.column("stream"), b.column("seq"), pa.array(np.concatenate(times)), pa.array(np.array(STATES)[np.concatenate(states)])], ["stream", "seq", "t", "side"])

    dealt = cut.select(*keys, "seq", "w", "v")
    if single:
        begun = dealt.withColumns({"from_state": F.lit(0).cast("long"), "from_t": F.lit(0).cast("long")})
    else:
        ends = slices.in_order(dealt, keys, order).mapInArrow(sums, sum_schema)
        begun = slices.beside(dealt, ends.groupBy("stream").applyInArrow(carry, f"{key_schema}, from_state long, from_t long"), keys)
    return slices.in_order(begun, keys, order).mapInArrow(results, f"stream {kinds['stream']}, seq {kinds['seq']}, t long, side string")
