"""Distributions of event times: inverse gaps, gap histograms with fitted laws, counts per slot."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tickspark.functions import bins
from tickspark.functions.timeunits import duration, label, whole
from tickspark.operators.resample import window_edges
from tickspark.operators.running import numbered, previous


def every_edge(out: DataFrame, every: str | int, by: list[str]) -> DataFrame:
    """``out`` with a row for each window between a stream's first and last, nulls where there was none."""
    i = duration(every)
    span = out.groupBy(*by).agg(F.min("edge").alias("lo"), F.max("edge").alias("hi"))
    grid = span.select(*by, F.explode(F.sequence("lo", "hi", F.lit(i).cast("long"))).alias("edge"))
    return grid.join(out, [*by, "edge"], "left")


def evt_erlagg(events: DataFrame, every: str | int | None = None, offset: str | int = 0, by: list[str] | None = None, empty: bool = False) -> DataFrame:
    """For each window the sum of 1 / gap over its events, gaps in seconds from the event before, plus ``offset``.

    empty: also windows without events, with null.
    """
    by = by or []
    rows = previous(window_edges(events, every, by), {"_t": "t"}, by).where("_t is not null")
    gap = (F.col("t") - F.col("_t") + duration(offset)) / 1e9
    out = rows.groupBy(*by, "edge").agg(F.round(F.sum(1 / F.nullif(gap, F.lit(0.0))), 6).alias("erlagg"), F.count(F.lit(1)).alias("n"))
    out = every_edge(out, every, by) if empty and every is not None else out
    return out.select(label(F.col("edge"), every).alias("cndl"), *by, "erlagg", "n")


def evt_erlang(events: DataFrame, every: str | int | None = None, base: str | int = 0, k: int = 1, res: int = 0, elapsed: bool = False, by: list[str] | None = None) -> DataFrame:
    """Histogram of the gaps between every k-th event of a window, those of at least ``base``: cndl, bin, lo, hi (seconds), cnt.

    A window's first event only starts it. elapsed: sum the gaps (in seconds) instead of counting them.
    """
    by = by or []
    rows = numbered(window_edges(events, every, by), [*by, "edge"]).where((F.col("_n") - 1) % k == 0)
    rows = previous(rows, {"_t": "t"}, [*by, "edge"]).withColumn("gap", F.col("t") - F.col("_t")).where(F.col("gap") >= duration(base))
    slot = bins.octave_bin(whole(F.col("gap"), 10**6), max(bins.BITS[res], 5), 1000)
    weight = F.col("gap") / 1e9 if elapsed else F.lit(1)
    out = rows.groupBy(*by, "edge", slot.alias("bin")).agg((F.min("gap") / 1e9).alias("lo"), (F.max("gap") / 1e9).alias("hi"), F.sum(weight).alias("cnt"))
    return out.select(label(F.col("edge"), every).alias("cndl"), *by, "bin", "lo", "hi", "cnt")


def fit_gaps(hist: DataFrame, k: int = 1, by: tuple[str, ...] = ("cndl",)) -> DataFrame:
    """Laws fitted to a gap histogram: Erlang (shape k, rate a second), gamma (shape; its rate is set to the same value) and
    Lomax. All gaps count. Bin 0 stays out of the sums and logs of gamma and Lomax, whose gaps are in nanoseconds."""
    n, hi = F.col("cnt").cast("double"), F.col("hi")
    above = lambda x: F.sum(F.when((F.col("bin") > 0) & (hi > 0), x))
    sums = hist.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * hi).alias("all"), above(n * hi).alias("total"), above(n * F.log(hi)).alias("logs"), above(n * F.log(hi * 1e9)).alias("logs_ns"))
    s = F.log("total") - F.log("n") - F.col("logs") / F.col("n")
    shape = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)
    gamma = F.sqrt(shape * (shape * F.col("n") / (F.col("total") * 1e9)))
    r = lambda x, digits=6: F.round(x, digits)
    return sums.select(*by, F.col("n").cast("long").alias("n"), F.lit(k).alias("erlang_shape"), r(F.col("n") * k / F.nullif("all", F.lit(0.0)), 12).alias("erlang_rate"), r(gamma, 12).alias("gamma_shape"), r(F.col("n") / F.nullif("logs_ns", F.lit(0.0)), 9).alias("lomax_shape"))


def evt_poisson(events: DataFrame, base: str | int, every: str | int | None = None, by: list[str] | None = None) -> DataFrame:
    """How many slots of length ``base`` hold k events, between a window's first and last slot: cndl, k, cnt."""
    by = by or []
    slots = window_edges(events, every, by).groupBy(*by, "edge", whole(F.col("t"), duration(base)).alias("slot")).agg(F.count(F.lit(1)).alias("k"))
    counts = slots.groupBy(*by, "edge", "k").agg(F.count(F.lit(1)).alias("cnt"))
    span = slots.groupBy(*by, "edge").agg((F.max("slot") - F.min("slot") + 1 - F.count(F.lit(1))).alias("cnt")).where("cnt > 0").select(*by, "edge", F.lit(0).cast("long").alias("k"), "cnt")
    return counts.unionByName(span).select(label(F.col("edge"), every).alias("cndl"), *by, "k", "cnt")


def fit_zip(counts: DataFrame, by: tuple[str, ...] = ("cndl",), steps: int = 10) -> DataFrame:
    """Zero-inflated Poisson law of slot counts: rate and the share of extra zeros, by a fixed number of steps from rate 2."""
    sums = counts.groupBy(*by).agg(F.sum("cnt").alias("n"), (F.sum(F.col("k") * F.col("cnt")) / F.sum("cnt")).alias("mean"), (F.coalesce(F.sum(F.when(F.col("k") == 0, F.col("cnt"))), F.lit(0)) / F.sum("cnt")).alias("zeros")).withColumn("rate", F.lit(2.0))
    for _ in range(steps):
        sums = sums.withColumn("rate", F.col("mean") * (1 - F.exp(-F.col("rate"))) / (1 - F.col("zeros")))
    return sums.select(*by, "n", F.round("mean", 6).alias("mean"), F.round("rate", 6).alias("rate"), F.round(1 - F.col("mean") / F.col("rate"), 6).alias("extra"))


@pandas_udf(DoubleType())
def _lgamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.lgamma(v) if v is not None and v > 0 else None)


def log_poisson(k: Column, rate: Column) -> Column:
    return k * F.log(rate) - rate - _lgamma(k.cast("double") + 1)


def log_zip(k: Column, rate: Column, extra: Column) -> Column:
    """Log-probability of k under a Poisson law with a share ``extra`` of additional zeros."""
    return F.when(k == 0, F.log(extra + (1 - extra) * F.exp(-rate))).otherwise(F.log(1 - extra) + log_poisson(k, rate))


def log_gamma(x: Column, shape: Column, rate: Column) -> Column:
    return shape * F.log(rate) + (shape - 1) * F.log(x) - rate * x - _lgamma(shape.cast("double"))


def log_lomax(x: Column, shape: Column, scale: Column) -> Column:
    return F.log(shape / scale) - (shape + 1) * F.log(1 + x / scale)


def fitted_gaps(hist: DataFrame, k: int = 1, by: tuple[str, ...] = ("cndl",)) -> DataFrame:
    """``hist`` with what each fitted law expects in a bin: its density at the bin's largest gap, scaled so that all bins of a
    histogram add up to its count. Null where a bin has no gap above 0."""
    fits = fit_gaps(hist, k, by)
    rows = hist.join(fits, list(by)).withColumn("_x", F.when(F.col("hi") > 0, F.col("hi")))
    laws = {
        "erlang": F.log("erlang_rate") * k + F.log("_x") * (k - 1) - F.col("erlang_rate") * F.col("_x") - math.lgamma(k),
        "gamma": log_gamma(F.col("_x"), F.col("gamma_shape"), F.col("gamma_shape")),
        "lomax": log_lomax(F.col("_x") * 1e9, F.col("lomax_shape"), F.lit(1.0)),
    }
    return _scaled(rows, laws, F.col("n"), by).select(*hist.columns, *laws)


def fitted_slots(counts: DataFrame, by: tuple[str, ...] = ("cndl",)) -> DataFrame:
    """``counts`` with how many slots of k events the zero-inflated Poisson law expects."""
    rows = counts.join(fit_zip(counts, by), list(by))
    return rows.select(*counts.columns, F.round(F.col("n") * F.exp(log_zip(F.col("k"), F.col("rate"), F.col("extra"))), 6).alias("zip"))


def _scaled(rows: DataFrame, laws: dict[str, Column], total: Column, by: tuple[str, ...]) -> DataFrame:
    """Shares of the laws' densities in their sum over a histogram's bins, which are bounded, times the total."""
    over = Window.partitionBy(*by)
    dense = rows.withColumns({f"_{name}": F.exp(law) for name, law in laws.items()})
    return dense.withColumns({name: F.round(total * F.col(f"_{name}") / F.sum(f"_{name}").over(over), 6) for name in laws})
