"""Order-dependent state machines: moving quotes and turns in hindsight over slices; and a fold of a stream in one task, batch by
batch, with a state of fixed size, for what can't be sliced."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_FLOOR, Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tickspark.functions.decimals import places_of, scaled
from tickspark.operators import slices


def fold(df: DataFrame, by: list[str], columns: list[str], fields: str, start: Callable[[], dict], step: Callable, keep: list[str] | None = None, finish: Callable | None = None, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """Runs ``step(state, *columns)`` over each stream of ``by`` in order; each step yields tuples of ``fields``.

    ``keep`` columns of the row and ``by`` lead each result. finish(state): yields what a stream ends with; then ``keep``
    must be empty. A stream isn't gathered: sorted partitions stream through, and only the state is held.
    """
    keep = keep or []
    kinds = dict(df.dtypes)
    names = [*by, *keep, *re.findall(r"(?:^|,)\s*(\w+) ", fields)]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, *keep)), fields])
    need = list(dict.fromkeys([*by, *keep, *columns]))
    dealt = df.repartition(*by) if by else df.repartition(1)
    rows = dealt.sortWithinPartitions(*by, *order).select(*need)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, None
        for batch in batches:
            out = []
            streams = list(zip(*(batch[c] for c in by), strict=True)) if by else [()] * len(batch)
            kept = list(zip(*(batch[c] for c in keep), strict=True)) if keep else [()] * len(batch)
            values = list(zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in columns), strict=True))
            for stream, k, v in zip(streams, kept, values, strict=True):
                if stream != own or state is None:
                    if state is not None and finish:
                        out += [(*own, *x) for x in finish(state)]
                    own, state = stream, start()
                out += [(*stream, *k, *x) for x in step(state, *v)]
            yield pd.DataFrame(out, columns=names)
        if state is not None and finish:
            yield pd.DataFrame([(*own, *x) for x in finish(state)], columns=names)

    return rows.mapInPandas(run, schema)


def whole_prices(quotes: DataFrame, by: list[str], every_rows: int, order: tuple[str, ...] = ("t", "seq")) -> tuple[DataFrame, bool, int]:
    """(by, order, t, b, a, row, _slice) of the quotes that have both prices, as whole numbers of the last of so many places, and
    whether each stream is a single slice."""
    places = places_of(quotes, 9)
    price = lambda c: (F.col(c) * 10**places).cast("long")
    rows = quotes.where("bid is not null and ask is not null").select(*by, *order, price("bid").alias("b"), price("ask").alias("a"), F.struct(*quotes.columns).alias("row"))
    return *slices.sliced(rows, by, every_rows), places


def whole_amount(x: float | str, places: int) -> int:
    """An amount in whole units of the last place, rounded down: whole numbers exceed it where they exceed the amount."""
    return int((Decimal(str(x)) * 10**places).to_integral_value(ROUND_FLOOR))


class Moves(slices.Machine):
    """The last quote that moved. A quantum of None stands for the latent rule."""

    state, initial, seen = ("b", "a"), (0, 0), ("low_b", "high_b", "low_a", "high_a")

    def __init__(self, quantum: int | None, repeat: bool):
        self.quantum, self.repeat = quantum, repeat

    def guess(self, t: int, b: int, a: int) -> tuple:
        return b, a

    def run(self, state: tuple, t: list[int], b: list[int], a: list[int], emit: Callable | None = None) -> tuple:
        (x, y), q = state, self.quantum
        for i, (bid, ask) in enumerate(zip(b, a, strict=True)):
            if (abs(bid - x) > q or abs(ask - y) > q) if q is not None else not 2 * bid <= x + y <= 2 * ask:
                x, y = bid, ask
            elif not self.repeat:
                continue
            if emit:
                emit(i, x, y)
        return x, y

    def observe(self, seen: tuple | None, t: list[int], b: list[int], a: list[int]) -> tuple:
        both = seen or (b[0], b[0], a[0], a[0])
        return min(both[0], *b), max(both[1], *b), min(both[2], *a), max(both[3], *a)

    def quiet(self, state: tuple, seen: tuple) -> tuple | None:
        (x, y), (low_b, high_b, low_a, high_a), q = state, seen, self.quantum
        still = max(high_b - x, x - low_b, high_a - y, y - low_a) <= q if q is not None else 2 * high_b <= x + y <= 2 * low_a
        return state if still else None


def qq(quotes: DataFrame, quantum: float | str | None = None, repeat: bool = False, by: list[str] | None = None, rows: int = slices.ROWS, told: list[int] | None = None) -> DataFrame:
    """Quotes that move: with a quantum, by more than it in bid or ask against the last one emitted; without, those whose
    bid and ask don't hold the latent middle between them, which then becomes their middle. repeat: also rows that don't
    move, with the last prices.

    A stream is cut into slices of ``rows`` rows, see ``slices``; told gets the slices run in each round.
    """
    by = ["instr"] if by is None else by
    given, single, places = whole_prices(quotes, by, rows)
    machine = Moves(None if quantum is None else whole_amount(quantum, places), repeat)
    schema = StructType([StructField("row", quotes.schema), StructField("b", LongType()), StructField("a", LongType())])

    def result(b: pa.RecordBatch, places: list[int], values: list[tuple]) -> pa.RecordBatch:
        prices = (pa.array([v[k] for v in values], pa.int64()) for k in (0, 1))
        return pa.record_batch([b.column("row").take(pa.array(places, pa.int64())), *prices], ["row", "b", "a"])

    out = slices.emitted(given, None if single else slices.settled_starts(given, machine, by, told=told), machine, by, schema, result)
    kind = dict(quotes.dtypes)
    moved = {"bid": "b", "ask": "a"}
    return out.select(*(scaled(F.col(moved[c]), places).cast(kind[c]).alias(c) if c in moved else F.col(f"row.`{c}`") for c in quotes.columns))


def mid_latent(quotes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Quotes that don't hold the latent middle: ``qq`` without a quantum, under its other name."""
    return qq(quotes, by=by)


class Turns(slices.Machine):
    """The side held, and the extreme since: the highest bid on the long side, the lowest ask on the short one, both before the
    first turn, with the last time of each. The extreme of the other side doesn't matter while a side is held."""

    state, initial, seen = ("side", "high", "high_t", "low", "low_t"), (0, None, None, None, None), ("high", "high_t", "low", "low_t", "fall", "rise")

    def __init__(self, limit: int):
        self.limit = limit

    def guess(self, t: int, b: int, a: int) -> tuple:
        return self.initial

    def run(self, state: tuple, t: list[int], b: list[int], a: list[int], emit: Callable | None = None) -> tuple:
        (side, high, high_t, low, low_t), limit = state, self.limit
        for i, (at, bid, ask) in enumerate(zip(t, b, a, strict=True)):
            if side >= 0:
                if high is None or bid >= high:
                    high, high_t = bid, at
                elif high - ask > limit:
                    if emit:
                        emit(i, high_t, "SHORT", abs(high))
                    side, high, high_t, low, low_t = -1, None, None, ask, at
            if side <= 0:
                if low is None or ask <= low:
                    low, low_t = ask, at
                elif bid - low > limit:
                    if emit:
                        emit(i, low_t, "LONG", abs(low))
                    side, high, high_t, low, low_t = 1, bid, at, None, None
        return side, high, high_t, low, low_t

    def observe(self, seen: tuple | None, t: list[int], b: list[int], a: list[int]) -> tuple:
        high, high_t, low, low_t, fall, rise = seen or (b[0], t[0], a[0], t[0], -(2**62), -(2**62))
        for at, bid, ask in zip(t, b, a, strict=True):
            if bid >= high:
                high, high_t = bid, at
            elif high - ask > fall:
                fall = high - ask
            if ask <= low:
                low, low_t = ask, at
            elif bid - low > rise:
                rise = bid - low
        return high, high_t, low, low_t, fall, rise

    def quiet(self, state: tuple, seen: tuple) -> tuple | None:
        side, own_high, own_high_t, own_low, own_low_t = state
        high, high_t, low, low_t, fall, rise = seen
        if side >= 0:  # no turn to the short side, neither from the slice's own heights nor from the one before
            if own_high is None or max(fall, own_high - low) > self.limit:
                return None
            own_high, own_high_t = max((own_high, own_high_t), (high, high_t))
        if side <= 0:
            if own_low is None or max(rise, high - own_low) > self.limit:
                return None
            own_low, own_low_t = (low, low_t) if low <= own_low else (own_low, own_low_t)
        return side, own_high, own_high_t, own_low, own_low_t


def opt(quotes: DataFrame, thresh: float | str = 0, limit_orders: bool = False, by: list[str] | None = None, rows: int = slices.ROWS, told: list[int] | None = None) -> DataFrame:
    """Trades that were best in hindsight: a turn is known once a reversal by more than ``thresh`` beyond the spread is seen,
    and stamped where it lay; the position is cancelled at the last extreme. price is given with limit_orders.

    Streams are cut as for ``qq``.
    """
    by = ["instr"] if by is None else by
    given, single, places = whole_prices(quotes, by, rows)
    machine = Turns(whole_amount(thresh, places))
    kinds = {f.name: f for f in quotes.schema}
    schema = StructType([*(kinds[c] for c in by), StructField("t", LongType()), StructField("side", StringType()), StructField("price", LongType())])
    arrow = to_arrow_schema(schema)

    def made(keys: list[pa.Array], values: list[tuple]) -> pa.RecordBatch:
        rest = [pa.array([v[k] for v in values], arrow.field(len(by) + k).type) for k in range(3)]
        return pa.RecordBatch.from_arrays([k.cast(f.type) for k, f in zip(keys, arrow, strict=False)] + rest, arrow.names)

    def result(b: pa.RecordBatch, places: list[int], values: list[tuple]) -> pa.RecordBatch:
        return made([b.column(c).take(pa.array(places, pa.int64())) for c in by], values)

    def finish(key: tuple, state: tuple) -> pa.RecordBatch:
        side, high, high_t, low, low_t = state
        values = [(high_t, "CANCEL", abs(high)) if side > 0 else (low_t, "CANCEL", abs(low))] if side else []
        return made([pa.array([k] * len(values), f.type) for k, f in zip(key, arrow, strict=False)], values)

    out = slices.emitted(given, None if single else slices.settled_starts(given, machine, by, told=told), machine, by, schema, result, finish)
    price = scaled(F.col("price"), places).cast(dict(quotes.dtypes)["bid"]) if limit_orders else F.lit(None).cast(dict(quotes.dtypes)["bid"])
    return out.select(*by, "t", "side", price.alias("price"))
