"""Row-wise changes of quotes, and tick patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.operators.running import previous


def _prices(df: DataFrame, bid: Column, ask: Column, places: int) -> DataFrame:
    kind = f"decimal(28,{places})"
    return df.withColumns({"bid": F.round(bid, places).cast(kind), "ask": F.round(ask, places).cast(kind)})


def _amount(x: float | str) -> Column:
    return F.lit(str(x)).cast("decimal(18,9)")


def mid(quotes: DataFrame, spread: float | str = 0, places: int = 5) -> DataFrame:
    """Bid and ask set ``spread`` apart around the middle; places: decimals of the prices."""
    m, half = (F.col("bid") + F.col("ask")) / 2, _amount(spread) / 2
    return _prices(quotes, m - half, m + half, places)


def mid_widen(quotes: DataFrame, by: float | str, places: int = 5) -> DataFrame:
    """The spread changed by an amount around the middle; the opposite amount undoes it."""
    half = _amount(by) / 2
    return _prices(quotes, F.col("bid") - half, F.col("ask") + half, places)


def mid_spread(quotes: DataFrame) -> DataFrame:
    """mid, spread, mean quantity and sell imbalance in place of prices and quantities."""
    rest = [c for c in quotes.columns if c not in ("bid", "ask", "bsz", "asz")]
    return quotes.select(*rest, ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"), ((F.col("bsz") + F.col("asz")) / 2).alias("qty"), (F.col("asz") - F.col("bsz")).alias("imbalance"))


def despread(rows: DataFrame) -> DataFrame:
    """The inverse of ``mid_spread``."""
    rest = [c for c in rows.columns if c not in ("mid", "spread", "qty", "imbalance")]
    return rows.select(*rest, (F.col("mid") - F.col("spread") / 2).alias("bid"), (F.col("mid") + F.col("spread") / 2).alias("ask"), (F.col("qty") - F.col("imbalance") / 2).alias("bsz"), (F.col("qty") + F.col("imbalance") / 2).alias("asz"))


def pat(quotes: DataFrame, absolute: bool = False, by: tuple[str, ...] = ("instr",)) -> DataFrame:
    """The signs of the last two ticks, the one before and this one, as two characters each for bid and ask.

    Rows for which both signs before are even (=) leave, and so do an instrument's first two. absolute: both signs are
    taken times the one before, if that isn't even.
    """
    one = previous(quotes, {"_b1": "bid", "_a1": "ask"}, list(by))
    two = previous(one, {"_b2": "_b1", "_a2": "_a1"}, list(by))
    sign = lambda x, y: F.signum(F.col(x) - F.col(y)).cast("int")
    rows = two.where("_b2 is not null and _a2 is not null").withColumns({"_pb": sign("_b1", "_b2"), "_pa": sign("_a1", "_a2"), "_b": sign("bid", "_b1"), "_a": sign("ask", "_a1")}).where("_pb <> 0 or _pa <> 0")
    if absolute:
        turn = lambda c, before: F.col(c) * F.when(F.col(before) == 0, 1).otherwise(F.col(before))
        rows = rows.withColumns({"_b": turn("_b", "_pb"), "_a": turn("_a", "_pa"), "_pb": F.abs("_pb"), "_pa": F.abs("_pa")})
    char = lambda c: F.when(F.col(c) < 0, "<").when(F.col(c) > 0, ">").otherwise("=")
    return rows.select("t", "seq", *by, F.concat(char("_pb"), char("_b")).alias("bid_pattern"), F.concat(char("_pa"), char("_a")).alias("ask_pattern"))
