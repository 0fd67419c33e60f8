"""Order-dependent computations over slices of a stream, so that one instrument is spread over tasks.

A stream is cut into slices of about equal numbers of rows. Within a slice rows go through Python in order, batch by batch,
with a state of fixed size; what a slice starts from is settled over one row for each slice.

* ``decayed``: weights, sums and squares that decay with time. A slice is an affine map of what it starts from, so that two
  passes over the rows do, whatever the number of slices.
* ``settled_starts``: state machines. Slices run from a guess at the same time; then starts are settled along each stream from
  the slices' ends. A slice that leaves a start as it is, by its extremes, needs no run; one that ran from another start than
  it turns out to have is run again, and its end is taken as right until then. Rounds end when no start has changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickspark.functions.timeunits import duration, whole
from tickspark.operators.lineage import settled

#: Rows of a slice, and parts into which a stretch of time is cut at most.
ROWS, PARTS = 1_000_000, 1024
STRETCH = "52w"


def sliced(df: DataFrame, by: list[str], rows: int = ROWS, every: str | int = STRETCH) -> tuple[DataFrame, bool]:
    """``df`` with ``_slice``, a number that grows along each stream, and whether each stream is a single slice.

    A stretch of ``every`` is cut where a quantile sketch of its times says that ``rows`` rows are reached. Rows of one time stay
    together. Rows are counted first, as there is nothing to cut, nor to carry from slice to slice, where streams are short.
    """
    cell = whole(F.col("t"), duration(every))
    sizes = df.groupBy(*by, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_rows"))
    most, cells = sizes.groupBy(*by).agg(F.max("_rows").alias("m"), F.count(F.lit(1)).alias("c")).agg(F.max("m"), F.max("c")).first()
    named = df.withColumn("_cell", cell)
    if (most or 0) <= rows:
        return named.withColumnRenamed("_cell", "_slice"), (cells or 1) == 1
    shares = [i / PARTS for i in range(1, PARTS)]
    found = df.groupBy(*by, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx("t", shares, 10 * PARTS).alias("_at")).where(F.col("_rows") > rows)
    need = F.least(F.ceil(F.col("_rows") / rows), F.lit(PARTS)).cast("int")
    step = lambda i: F.floor(i * need / PARTS)
    # a sketch depends on the order in which its parts arrive, so that it may cut elsewhere when it is made again: it is made once
    bounds = settled(found.select(*by, "_cell", F.array_distinct(F.filter("_at", lambda x, i: step(i + 1) > step(i))).alias("_bounds")))
    part = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("t"))), F.lit(0))
    cut = beside(named, bounds, [*by, "_cell"], "left")
    return cut.select(*df.columns, (F.col("_cell") * PARTS + F.when(F.col("_bounds").isNull(), 0).otherwise(part)).alias("_slice")), False


def in_order(df: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Rows dealt by slice, those of a slice one after the other."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def segments(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of rows of a batch that have equal keys."""
    turn = np.zeros(batch.num_rows, bool)
    turn[:1] = True
    for c in keys:
        codes = np.asarray(batch.column(c).dictionary_encode().indices.fill_null(-1))
        turn[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(turn).tolist()
    return zip(at, [*at[1:], batch.num_rows], strict=True)


def key_of(batch: pa.RecordBatch, keys: list[str], at: int) -> tuple:
    return tuple(batch.column(c)[at].as_py() for c in keys)


def decayed(df: DataFrame, columns: list[str], base: float, by: list[str], single: bool, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """``df``, which has ``_slice``, with the weighted mean and deviation of double columns so far as column_mean and column_dev.

    Before a value counts, what a stream holds is taken times base ** (seconds since the row before): its weights, its
    weighted sum, and the weighted squares of what is left of a value beside its mean. All three are recurrences, so a slice
    is an affine map of what it starts from. Weights and sums are carried first; squares, which need means, after a
    second pass. A null neither counts nor decays what is there. single: each stream is one slice, so nothing is carried.
    """
    keys, given = [*by, "_slice"], df.columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    listed = lambda names, kind: [f"`{n}` {kind}" for n in names]
    key_schema = [f"`{c}` {kinds[c]}" for c in keys]
    ends = [f"_{k}_{c}" for c in columns for k in ("p", "n", "s", "lone")]
    starts = ["_from_t", *(f"_from_{k}_{c}" for c in columns for k in ("n", "s"))]
    made = [f"_{k}_{c}" for c in columns for k in ("m", "w", "q", "p")]
    rows = in_order(df, keys, order)

    def decay(t: list[int], last: int | None) -> list[float]:
        """The factor of each row; of the first one 0 if there is no row before."""
        out = []
        for at in t:
            out.append(0.0 if last is None else base ** ((at - last) / 1e9))
            last = at
        return out

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each slice makes of nothing, and the factor on what it starts from, its first row's left out."""
        own = first = last = None
        held: dict = {}
        row = lambda: pa.RecordBatch.from_pydict({n: [v] for n, v in zip([*keys, "first", "last", *ends], [*own, first, last, *(x for c in columns for x in held[c])], strict=True)}, schema=types)
        for b in batches:
            for lo, hi in segments(b, keys):
                t, key = b.column("t")[lo:hi].to_pylist(), key_of(b, keys, lo)
                if key != own:
                    if own is not None:
                        yield row()
                    own, first, last, held = key, t[0], None, {c: None for c in columns}
                factors = decay(t, last)
                for c in columns:
                    values = b.column(c)[lo:hi].to_pylist()
                    p, n, s, lone = held[c] or (1.0, 0.0, 0.0, values[0] is None)
                    for i, (f, x) in enumerate(zip(factors, values, strict=True)):
                        if x is not None:
                            p, n, s = p * (f if i or last is not None else 1.0), n * f + 1, s * f + x
                    held[c] = p, n, s, lone
                last = t[-1]
        if own is not None:
            yield row()

    def carry(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice").to_pydict()
        out, last, held = {n: [] for n in starts}, None, dict.fromkeys(columns, (0.0, 0.0))
        for i, first in enumerate(table["first"]):
            out["_from_t"].append(last)
            for c in columns:
                p, n, s, lone = (table[f"_{k}_{c}"][i] for k in ("p", "n", "s", "lone"))
                link = 1.0 if lone else 0.0 if last is None else base ** ((first - last) / 1e9)
                for k, value in zip(("n", "s"), held[c], strict=True):
                    out[f"_from_{k}_{c}"].append(value)
                held[c] = n + p * link * held[c][0], s + p * link * held[c][1]
            last = table["last"][i]
        return pa.table({k: table[k] for k in keys} | out).cast(carried)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = last = None
        held: dict = {}
        for b in batches:
            out: dict[str, list] = {n: [] for n in made}
            for lo, hi in segments(b, keys):
                t, key = b.column("t")[lo:hi].to_pylist(), key_of(b, keys, lo)
                if key != own:
                    own, begun = key, (None,) if single else key_of(b, starts, lo)
                    last = begun[0]
                    held = {c: ((0.0, 0.0) if single else begun[1 + 2 * i : 3 + 2 * i]) + (0.0, 1.0) for i, c in enumerate(columns)}
                factors = decay(t, last)
                for c in columns:
                    n, s, q, p = held[c]
                    means, weights, squares, products = (out[f"_{k}_{c}"] for k in ("m", "w", "q", "p"))
                    for f, x in zip(factors, b.column(c)[lo:hi].to_pylist(), strict=True):
                        if x is None:
                            means.append(None)
                        else:
                            n, s, p = n * f + 1, s * f + x, p * f
                            means.append(s / n)
                            q = q * f + (x - s / n) ** 2
                        weights.append(n)
                        squares.append(q)
                        products.append(p)
                    held[c] = n, s, q, p
                last = t[-1]
            yield pa.record_batch([*(b.column(c) for c in given), *(pa.array(out[n], pa.float64()) for n in made)], [*given, *made])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in given), *listed(made, "double")])
    if single:
        found, before = rows.mapInArrow(results, schema), {c: F.lit(0.0) for c in columns}
    else:
        sum_schema = ", ".join([*key_schema, "first long", "last long", *(f"`{n}` {'boolean' if '_lone_' in n else 'double'}" for n in ends)])
        start_schema = ", ".join([*key_schema, "_from_t long", *listed(starts[1:], "double")])
        types, carried = (to_arrow_schema(StructType.fromDDL(x)) for x in (sum_schema, start_schema))
        begun = rows.mapInArrow(sums, sum_schema).groupBy(*by).applyInArrow(carry, start_schema)
        local = in_order(beside(rows, begun, keys), keys, order).mapInArrow(results, schema)
        squares = [f"_{k}_{c}" for c in columns for k in ("q", "p")]
        last = local.groupBy(*keys).agg(F.max_by(F.struct(*squares), F.struct(*order)).alias("end")).select(*keys, "end.*")
        names, more = [f"_before_{c}" for c in columns], ", ".join([*key_schema, *(f"`_before_{c}` double" for c in columns)])

        def carry_squares(table: pa.Table) -> pa.Table:
            table = table.sort_by("_slice")
            out = {}
            for c, name in zip(columns, names, strict=True):
                y, out[name] = 0.0, []
                for q, p in zip(table.column(f"_q_{c}").to_pylist(), table.column(f"_p_{c}").to_pylist(), strict=True):
                    out[name].append(y)
                    y = q + p * y
            return pa.table([*(table.column(k) for k in keys), *(pa.array(x, pa.float64()) for x in out.values())], [*keys, *out])

        found = beside(local, last.groupBy(*by).applyInArrow(carry_squares, more), keys)
        before = {c: F.col(f"_before_{c}") for c in columns}
    dev = lambda c: F.when(F.col(f"_m_{c}").isNotNull(), F.sqrt((F.col(f"_q_{c}") + F.col(f"_p_{c}") * before[c]) / F.col(f"_w_{c}")))
    return found.select(*given, *(x for c in columns for x in (F.col(f"_m_{c}").alias(f"{c}_mean"), dev(c).alias(f"{c}_dev"))))


def beside(rows: DataFrame, slices: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of rows with what is known of their slices; null keys meet."""
    renamed = slices.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(c for c in slices.columns if c not in keys))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return rows.join(renamed, on, how).drop(*(f"_k{i}" for i in range(len(keys))))


class Machine:
    """A state machine over quotes whose prices are whole numbers. States are tuples of whole numbers or nulls.

    state: names of a state's fields; initial: what a stream starts from; seen: names of what is observed of a slice beside.
    """

    state: tuple[str, ...]
    initial: tuple
    seen: tuple[str, ...]

    def guess(self, t: int, b: int, a: int) -> tuple:
        """A state from which a slice with this first row may start."""
        raise NotImplementedError

    def run(self, state: tuple, t: list[int], b: list[int], a: list[int], emit: Callable | None = None) -> tuple:
        """The state behind rows in order. emit(place, ...) is called for each result."""
        raise NotImplementedError

    def observe(self, seen: tuple | None, t: list[int], b: list[int], a: list[int]) -> tuple:
        """What is known of a slice, some more of its rows included."""
        raise NotImplementedError

    def quiet(self, state: tuple, seen: tuple) -> tuple | None:
        """The state behind a slice if that follows from what is known of it, else None."""
        raise NotImplementedError


def _runs(rows: DataFrame, machine: Machine, keys: list[str], schema: str, order: tuple[str, ...], guessed: bool) -> DataFrame:
    """A row for each slice: what it ran from (s_), where it ended (e_), what was seen (o_). Rows have the columns t, b and a, and
    s_ columns unless the start is guessed."""
    names = [*keys, *(f"s_{c}" for c in machine.state), *(f"e_{c}" for c in machine.state), *(f"o_{c}" for c in machine.seen)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = start = state = seen = None
        made = lambda: pa.table([pa.array([x]) if x is not None else pa.nulls(1) for x in (*own, *start, *state, *seen)], names)
        for b in batches:
            for lo, hi in segments(b, keys):
                key = key_of(b, keys, lo)
                part = [b.column(c)[lo:hi].to_pylist() for c in ("t", "b", "a")]
                if key != own:
                    if own is not None:
                        yield from made().cast(types).to_batches()
                    own, seen = key, None
                    start = state = machine.guess(*(p[0] for p in part)) if guessed else key_of(b, [f"s_{c}" for c in machine.state], lo)
                state, seen = machine.run(state, *part), machine.observe(seen, *part)
        if own is not None:
            yield from made().cast(types).to_batches()

    types = to_arrow_schema(StructType.fromDDL(schema))
    return in_order(rows, keys, order).mapInArrow(run, schema)


def settled_starts(rows: DataFrame, machine: Machine, by: list[str], order: tuple[str, ...] = ("t", "seq"), told: list[int] | None = None) -> DataFrame:
    """(by, _slice, last, s_...): the state from which each slice starts, and whether it is its stream's last, for streams of
    several slices. told: gets the number of slices that each round had to run."""
    keys = [*by, "_slice"]
    kinds = dict(rows.dtypes)
    own = rows.select(*keys, *order, *(c for c in ("t", "b", "a") if c not in order))
    along = Window.partitionBy(*by).orderBy("_slice")
    slices = settled(own.select(*keys).distinct().withColumn("last", F.lead("_slice").over(along).isNull()))
    key_schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    field = lambda k, names: ", ".join(f"{k}_{c} long" for c in names)
    run_schema = ", ".join([key_schema, field("s", machine.state), field("e", machine.state), field("o", machine.seen)])
    open_ = slices.where("not last").select(*keys)
    runs = settled(_runs(beside(own, open_.withColumn("_one", F.lit(1)), keys).drop("_one"), machine, keys, run_schema, order, guessed=True))
    columns = [*(f"{k}_{c}" for k in "se" for c in machine.state), *(f"o_{c}" for c in machine.seen)]
    width = len(machine.state)

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice")
        state, starts, again = machine.initial, [], []
        for ran, *values in zip(table.column("ran").to_pylist(), *(table.column(c).to_pylist() for c in columns), strict=True):
            start, end, seen = tuple(values[:width]), tuple(values[width : 2 * width]), tuple(values[2 * width :])
            starts.append(state)
            passed = machine.quiet(state, seen) if ran else None
            again.append(bool(ran) and passed is None and start != state)
            state = passed if passed is not None else end
        made = [pa.array([s[i] for s in starts], pa.int64()) for i in range(width)]
        return pa.table([*(table.column(c) for c in keys), table.column("last"), pa.array(again, pa.bool_()), *made], [*keys, "last", "again", *(f"s_{c}" for c in machine.state)])

    start_schema = ", ".join([key_schema, "last boolean", "again boolean", field("s", machine.state)])
    while True:
        known = beside(slices, runs.withColumn("ran", F.lit(True)), keys, "left").withColumn("ran", F.coalesce("ran", F.lit(False)))
        starts = settled(known.groupBy(*by).applyInArrow(settle, start_schema))
        again = starts.where("again").select(*keys, *(f"s_{c}" for c in machine.state))
        n = again.count()
        if told is not None:
            told.append(n)
        if not n:
            return starts.drop("again")
        fresh = _runs(beside(own, again, keys), machine, keys, run_schema, order, guessed=False)
        rest = beside(runs, again.select(*keys, F.lit(1).alias("_one")), keys, "left").where("_one is null").drop("_one")
        runs = settled(rest.unionByName(fresh))


def emitted(rows: DataFrame, starts: DataFrame | None, machine: Machine, by: list[str], schema: StructType, result: Callable, finish: Callable | None = None, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """Results of a machine over all slices from their settled starts, as batches of ``schema``. result(batch, places, values): a
    batch from what was emitted at places of a batch of rows. finish(key, state): a batch from the state a stream ends with.
    starts: None if each stream is a single slice."""
    keys = [*by, "_slice"]
    names = [f"s_{c}" for c in machine.state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state = last = None
        for b in batches:
            places, values, parts = [], [], [b.column(c) for c in ("t", "b", "a")]
            for lo, hi in segments(b, keys):
                key = key_of(b, keys, lo)
                if key != own:
                    if last and finish:
                        yield finish(own[:-1], state)
                    own, state, last = key, key_of(b, names, lo), b.column("last")[lo].as_py()

                def emit(i: int, *value, lo=lo, places=places, values=values) -> None:
                    places.append(lo + i)
                    values.append(value)

                state = machine.run(state, *(p[lo:hi].to_pylist() for p in parts), emit)
            yield result(b, places, values)
        if last and finish:
            yield finish(own[:-1], state)

    if starts is None:
        begun = rows.select("*", F.lit(True).alias("last"), *(F.lit(x).cast("long").alias(n) for n, x in zip(names, machine.initial, strict=True)))
    else:
        begun = beside(rows, starts, keys)
    return in_order(begun, keys, order).mapInArrow(run, schema)
