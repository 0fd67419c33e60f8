"""SQL access: scalar functions, operators as table functions over any table, and the tick tables as views.

    SELECT * FROM candle(TABLE(quotes), '60s')
    SELECT * FROM moves(TABLE(quotes), '0.0003')
    SELECT * FROM turns(TABLE(SELECT * FROM quotes WHERE bid > 0), '5')
    SELECT * FROM weighted(TABLE(quotes), 'bid', '1h')

They deal a table's rows by its column instr and take each instrument in order of (t, seq) in one task, as a stream would; the
operators of ``tickspark.operators`` give the same rows and cut an instrument into slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.types import DecimalType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tickspark.functions.timeunits import duration
from tickspark.operators import folds
from tickspark.sources import ticks
from tickspark.streaming.stream import CANDLE, Candle

#: Bodies over BIGINT nanoseconds, in plain SQL so that they are part of the plan.
FUNCTIONS = {
    "ceil_bucket(t BIGINT, every BIGINT)": ("BIGINT", "((t - 1 - pmod(t - 1, every)) div every + 1) * every"),
    "window_label(edge BIGINT)": ("STRING", "concat(cast(edge div 1000000000 as string), '.', lpad(cast(pmod(edge, 1000000000) as string), 9, '0'))"),
    "cascade_round(value BIGINT, digits INT)": ("BIGINT", "(value + (5 * (cast(power(10, digits) as bigint) - 1)) div 9) div cast(power(10, digits) as bigint)"),
    "hour_of_week(t BIGINT)": ("BIGINT", "pmod(t - 345600000000000, 604800000000000) div 3600000000000"),
}


#: Bodies over the view quotes (t, seq, instr, bid, ask, bsz, asz); widths are BIGINT nanoseconds. Call tables() once it exists.
TABLES = {
    "align_quotes(every BIGINT)": """SELECT ((t - 1 - pmod(t - 1, every)) div every + 1) * every AS t, instr, x.seq, x.bid, x.ask, x.bsz, x.asz
        FROM (SELECT max(t) AS last, instr, ((t - 1 - pmod(t - 1, every)) div every + 1) * every AS t, max_by(struct(seq, bid, ask, bsz, asz), struct(t, seq)) AS x
        FROM quotes GROUP BY instr, ((t - 1 - pmod(t - 1, every)) div every + 1) * every)""",
    "mid_quotes()": "SELECT t, seq, instr, cast(bid + ask as double) / 2 AS mid, cast(ask - bid as double) AS spread FROM quotes",
}


def by_instrument(fields: list[StructField]) -> AnalyzeResult:
    """A table function's result of these fields, which takes each instrument's rows in order."""
    return AnalyzeResult(schema=StructType(fields), partitionBy=[PartitioningColumn("instr")], orderBy=[OrderingColumn("t"), OrderingColumn("seq")])


def fields_of(rows: AnalyzeArgument, *needed: str) -> dict[str, StructField]:
    fields = {f.name: f for f in rows.dataType} if rows.isTable else {}
    if missing := [c for c in ("t", "seq", "instr", *needed) if c not in fields]:
        raise ValueError(f"a table with the columns {', '.join(missing)} is needed")
    return fields


def difference(field: StructField) -> DecimalType | DoubleType | LongType:
    """The type of a difference of two values of a column."""
    kind = field.dataType
    return DecimalType(min(38, kind.precision + 1), kind.scale) if isinstance(kind, DecimalType) else kind


class CandleTable:
    """candle(TABLE(quotes), every): a row for each window, as of ``resample.candle``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, every: AnalyzeArgument) -> AnalyzeResult:
        own = fields_of(rows, "bid", "ask", "bsz", "asz")
        whole = {"_1st", "last", "mindlt", "maxdlt"}
        source = {"minask": own["ask"].dataType, "maxbid": own["bid"].dataType, "maxbsz": own["bsz"].dataType, "maxasz": own["asz"].dataType}
        kind = lambda n: LongType() if n in whole else source[n] if n in source else difference(own["bsz" if n in ("maxbim", "maxsim") else "bid"])
        return by_instrument([StructField("cndl", StringType()), StructField("instr", own["instr"].dataType), *(StructField(n, kind(n)) for n in CANDLE)])

    def __init__(self):
        self.window, self.instr = None, None

    def named(self, closed: tuple | None) -> Iterator[tuple]:
        if closed:
            yield (f"{closed[0] // 10**9}.{closed[0] % 10**9:09d}", self.instr, *closed[1:])

    def eval(self, row, every: str) -> Iterator[tuple]:
        self.window, self.instr = self.window or Candle(duration(every)), row["instr"]
        if row["bid"] and row["ask"]:
            yield from self.named(self.window.take(row["t"], row["bid"], row["ask"], row["bsz"], row["asz"]))

    def terminate(self) -> Iterator[tuple]:
        if self.window:
            yield from self.named(self.window.closed())


class MovesTable:
    """moves(TABLE(quotes), quantum): quotes that move, as of ``folds.qq``; without a quantum (NULL) by the latent rule."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, quantum: AnalyzeArgument) -> AnalyzeResult:
        own = fields_of(rows, "bid", "ask")
        return by_instrument([own[c] for c in ("t", "seq", "instr", "bid", "ask")])

    def __init__(self):
        self.state = folds.Moves.initial

    def eval(self, row, quantum: str | None) -> Iterator[tuple]:
        bid, ask = row["bid"], row["ask"]
        if bid is None or ask is None:
            return
        moved: list = []
        machine = folds.Moves(None if quantum is None else Decimal(quantum), repeat=False)
        self.state = machine.run(self.state, [row["t"]], [bid], [ask], lambda *x: moved.append(x))
        for _, b, a in moved:
            yield row["t"], row["seq"], row["instr"], b, a


class TurnsTable:
    """turns(TABLE(quotes), thresh): trades that were best in hindsight, with their prices, as of ``folds.opt``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, thresh: AnalyzeArgument) -> AnalyzeResult:
        own = fields_of(rows, "bid", "ask")
        return by_instrument([own["instr"], StructField("t", LongType()), StructField("side", StringType()), StructField("price", own["bid"].dataType)])

    def __init__(self):
        self.state, self.instr = folds.Turns.initial, None

    def eval(self, row, thresh: str) -> Iterator[tuple]:
        bid, ask, self.instr = row["bid"], row["ask"], row["instr"]
        if bid is None or ask is None:
            return
        turned: list = []
        self.state = folds.Turns(Decimal(thresh)).run(self.state, [row["t"]], [bid], [ask], lambda _, *x: turned.append(x))
        for at, side, price in turned:
            yield self.instr, at, side, price

    def terminate(self) -> Iterator[tuple]:
        side, high, high_t, low, low_t = self.state
        if side:
            yield (self.instr, high_t, "CANCEL", abs(high)) if side > 0 else (self.instr, low_t, "CANCEL", abs(low))


class WeightedTable:
    """weighted(TABLE(rows), column, halflife): exponentially weighted mean and deviation of a column, as of ``smooth.ewma``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, halflife: AnalyzeArgument) -> AnalyzeResult:
        own = fields_of(rows, column.value)
        return by_instrument([own["instr"], own["t"], own["seq"], StructField("mean", DoubleType()), StructField("dev", DoubleType())])

    def __init__(self):
        self.last, self.held = None, (0.0, 0.0, 0.0)

    def eval(self, row, column: str, halflife: str) -> Iterator[tuple]:
        base = max(1 - math.log(2) / (duration(halflife) / 1e9), 0.0)
        decay = 0.0 if self.last is None else base ** ((row["t"] - self.last) / 1e9)
        self.last, x = row["t"], row[column]
        if x is None:
            yield row["instr"], row["t"], row["seq"], None, None
            return
        x, (n, s, q) = float(x), self.held
        n, s = n * decay + 1, s * decay + x
        self.held = n, s, q * decay + (x - s / n) ** 2
        yield row["instr"], row["t"], row["seq"], s / n, math.sqrt(self.held[2] / n)


#: Operators as table functions over any table with the columns t, seq and instr.
OPERATORS = {"candle": CandleTable, "moves": MovesTable, "turns": TurnsTable, "weighted": WeightedTable}


def operators(spark: SparkSession) -> None:
    """Makes the operators known to the session's SQL as table functions."""
    from pyspark.sql.functions import udtf

    for name, handler in OPERATORS.items():
        spark.udtf.register(name, udtf(handler))


def tables(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL: SELECT * FROM align_quotes(2000000000)."""
    for head, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE RETURN {body}")


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")


def views(spark: SparkSession, sf_dir: str) -> None:
    """The ``events`` table as views quotes and trade_orders."""
    ticks.event_quotes(spark, sf_dir).createOrReplaceTempView("quotes")
    ticks.event_orders(spark, sf_dir).createOrReplaceTempView("trade_orders")
