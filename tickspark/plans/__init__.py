"""Registered queries over the driver's tables, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions import bins
from tickspark.operators import accounts, combine, events, execution, folds, generate, resample, smooth, transforms
from tickspark.operators.running import running_sums
from tickspark.plans.oracles import ORACLES
from tickspark.sources import ticks

TYPES = ("click", "error", "purchase", "signup", "view")
LEGS = {"click": 1, "view": -2}
LAGS = ["0s", "10m", "1h", "4h"]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison between engines."""
    return df.select(*(F.col(f"`{c}`").cast("double").alias(c) if kind.startswith("decimal") else F.col(f"`{c}`") for c, kind in df.dtypes))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # stamps of the tables are in UTC
    return ticks.event_quotes(spark, sf_dir)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ticks.event_orders(spark, sf_dir)


def account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as if each event bought (even numbers) or sold one unit at its own quote, for a cent of commission."""
    q = quotes(spark, sf_dir)
    side = F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)
    cash = -side * F.when(side > 0, F.col("ask")).otherwise(F.col("bid"))
    kind = "decimal(28,7)"
    sums = running_sums(q, {"base": side, "term": cash, "comt": F.lit("-0.01").cast("decimal(4,2)")}, ["instr"])
    return sums.select("t", "seq", "instr", F.col("base").cast(kind).alias("base"), F.col("term").cast(kind).alias("term"), F.lit(0).cast(kind).alias("comb"), F.col("comt").cast(kind).alias("comt"))


def exec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes(spark, sf_dir)
    return q.select("t", "seq", "instr", F.lit(1).cast("decimal(20,2)").alias("qty"), "ask", (F.col("ask") - F.col("bid")).alias("spread"))


def forwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forward on each event's instrument, at the event's time."""
    q = quotes(spark, sf_dir)
    points = lambda k: ((k + F.col("seq") % 3) * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(18,2)")
    return q.select("t", "seq", F.concat(F.lit("F"), F.col("instr")).alias("fwd_id"), F.col("instr").alias("underlying"), points(1).alias("bid"), points(2).alias("ask"))


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of all events."""
    return quotes(spark, sf_dir).select("t")


def shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; those of odd numbers name their instrument."""
    return quotes(spark, sf_dir).select("t", "seq", F.when(F.col("seq") % 2 == 1, F.col("instr")).alias("payload"))


def _sea(spark: SparkSession, sf_dir: str, mode: str = "adev") -> DataFrame:
    return smooth.sea_profile(quotes(spark, sf_dir), mode, "1d", "1h", by=["instr"])


def _one(f):
    """A query over the quotes alone."""
    return lambda spark, sf_dir: plain(f(quotes(spark, sf_dir)))


def _summed(arrays: DataFrame) -> DataFrame:
    """What each dense array holds, as numbers that engines can compare: its length, how many bins are filled, and where."""
    filled = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"].isNotNull() & ((e["x"] != 0) | (F.col("metric") != "n")))
    where = F.aggregate("filled", F.lit(0).cast("long"), lambda a, e: a + e["i"] * F.floor(e["x"] * 100000 + 0.5))  # whole, so that order doesn't matter
    rest = [c for c in arrays.columns if c != "v"]
    return arrays.select(*rest, F.size("v").alias("bins"), filled.alias("filled")).select(*rest, "bins", F.size("filled").cast("long").alias("filled"), where.alias("places"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates of lineitem as events; many share a time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(ticks.event_time("l_shipdate").alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("v"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "align": _one(lambda q: resample.align(q, "10m")),
    "align_offset": _one(lambda q: resample.align(q, "30m", "-90s")),
    "align_stamps": lambda s, d: plain(resample.align_stamps(quotes(s, d), stamps(s, d), "30s")),
    "align_multi": _one(lambda q: resample.align_multi(q, ["click", "view"], ["bid", "ask"], "10m")),
    "align_files": _one(lambda q: resample.align_files(ticks.split_files(q, 2), ["instr", "bid", "ask"], "10m")),
    "mid": _one(lambda q: transforms.mid(q, "0.02", 2)),
    "mid_widen": _one(lambda q: transforms.mid_widen(q, "0.04", 2)),
    "mid_spread": _one(transforms.mid_spread),
    "despread": _one(lambda q: transforms.despread(transforms.mid_spread(q)).select("t", "seq", "instr", "bid", "ask", "bsz", "asz")),
    "pat": _one(transforms.pat),
    "pat_absolute": _one(lambda q: transforms.pat(q, absolute=True)),
    "qq": _one(lambda q: folds.qq(q, "20")),
    "qq_repeat": _one(lambda q: folds.qq(q, "20", repeat=True)),
    "qq_latent": _one(folds.qq),
    "opt": _one(lambda q: folds.opt(q, "5", limit_orders=True)),
    "sex1": lambda s, d: plain(execution.sex1(orders(s, d), quotes(s, d), comb="0.001", comt="0.0001", qty=2, absqty=True)),
    "sex1_market": lambda s, d: plain(execution.sex1(orders(s, d).withColumn("limit_px", F.lit(None).cast("decimal(18,9)")), quotes(s, d), comb="0.001", comt="0.0001", qty=2, absqty=True)),
    "candle": _one(lambda q: resample.candle(q, "10m")),
    "candle_all": _one(resample.candle),
    "candle_day": _one(lambda q: resample.candle(q, "1d")),
    "quodist": _one(lambda q: resample.quodist(q, "4h", places=2)),
    "quodist_fine": _one(lambda q: resample.quodist(q, None, res=2, places=2)),
    "quodist_res1": _one(lambda q: resample.quodist(q, None, res=1, places=2)),
    "quodist_res3": _one(lambda q: resample.quodist(q, None, res=3, places=2)),
    "quodist_res4": _one(lambda q: resample.quodist(q, None, res=4, places=2)),
    "quodist_res5": _one(lambda q: resample.quodist(q, None, res=5, places=2)),
    "quodist_time": _one(lambda q: resample.quodist(q, None, elapsed=True, places=2)),
    "quodist_table": _one(lambda q: resample.to_table(resample.quodist(q, "1d", places=2))),
    "quodist_arrays": _one(lambda q: _summed(resample.to_arrays(resample.quodist(q, None, res=3, places=2), 1 << bins.BITS[3]))),
    "evt_erlang_all": _one(lambda q: resample.all_bins(events.evt_erlang(q, None, by=["instr"]), bins.octave_edges(5), ("cndl", "instr"))),
    "evt_erlang_arrays": _one(lambda q: _summed(resample.to_arrays(events.evt_erlang(q, None, by=["instr"]), 32, ("cndl", "instr")))),
    "loghist_arrays": lambda s, d: _summed(resample.to_arrays(resample.loghist(_lines(s, d), "v"), 32, ())),
    "evt_erlagg": _one(lambda q: events.evt_erlagg(q, "4h")),
    "evt_erlang": _one(lambda q: events.evt_erlang(q, None, k=2, by=["instr"])),
    "evt_erlang_fit": _one(lambda q: events.fit_gaps(events.evt_erlang(q, None, by=["instr"]), by=("cndl", "instr"))),
    "evt_erlang_fitted": _one(lambda q: events.fitted_gaps(events.evt_erlang(q, None, by=["instr"]), by=("cndl", "instr"))),
    "evt_poisson_fitted": _one(lambda q: events.fitted_slots(events.evt_poisson(q, "10m", by=["instr"]), by=("cndl", "instr"))),
    "evt_poisson": _one(lambda q: events.evt_poisson(q, "10m", by=["instr"])),
    "evt_poisson_fit": _one(lambda q: events.fit_zip(events.evt_poisson(q, "10m", by=["instr"]), by=("cndl", "instr"))),
    "loghist": lambda s, d: plain(resample.loghist(_lines(s, d), "v")),
    "loghist_sums": _one(lambda q: resample.loghist(q, "bid", k=3, by=["instr"])),
    "thours": lambda s, d: resample.thours(_lines(s, d)),
    "fra": lambda s, d: plain(combine.fra(forwards(s, d), quotes(s, d))),
    "spread": _one(lambda q: combine.spread(q, LEGS)),
    "eva": lambda s, d: plain(combine.eva(account_rows(s, d), quotes(s, d), "10m")),
    "imp": lambda s, d: plain(combine.imp(orders(s, d), quotes(s, d), LAGS)),
    "imp_tod": lambda s, d: plain(combine.imp(orders(s, d), quotes(s, d), ["2h", "12h"], abs_tod="1d")),
    "imp_summary": lambda s, d: combine.imp_summary(combine.imp(orders(s, d), quotes(s, d), LAGS)).select("lag", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "skew", "kurt"))),
    "xevent": lambda s, d: plain(combine.xevent(plain(quotes(s, d)), shocks(s, d), "3m", "1m", start=5, mark=True)),
    "rolling": _one(lambda q: smooth.rolling(plain(q), "1h", by=["instr"])),
    "sma": _one(lambda q: smooth.sma(q, "1h")),
    "ewma": lambda s, d: smooth.ewma(quotes(s, d), ["bid", "ask"], "1h", by=["instr"]).select("t", "seq", "instr", *(F.round(c, 6).alias(c) for c in ("bid_mean", "bid_dev", "ask_mean", "ask_dev"))),
    "sea_profile": lambda s, d: _sea(s, d).select("bin", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var")),
    "sea_profile_sprd": lambda s, d: _sea(s, d, "sprd").select("bin", "n", F.round("mean", 4).alias("mean"), F.round("var", 1).alias("var")),
    "sea_profile_velo": lambda s, d: _sea(s, d, "velo").select("bin", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var")),
    "sea_apply": lambda s, d: plain(smooth.sea_apply(quotes(s, d), _sea(s, d)).select("t", "seq", "instr", "bid", "ask")),
    "sea_reverse": lambda s, d: plain(smooth.sea_apply(quotes(s, d), _sea(s, d), reverse=True).select("t", "seq", "instr", "bid", "ask")),
    "sea_tdlt": lambda s, d: smooth.sea_apply(quotes(s, d), _sea(s, d, "tdlt"), mode="tdlt").select("t", "seq", "instr", F.round("seasoned", 0).alias("seasoned")),
    "accsum": lambda s, d: accounts.accsum(account_rows(s, d)),
    "accsum_gross": lambda s, d: accounts.accsum(account_rows(s, d), exec_rows(s, d), gross=2, edge=True),
    "accsum_report": lambda s, d: accounts.accsum_report(account_rows(s, d)),
    "accrpl": lambda s, d: accounts.accrpl(account_rows(s, d), rewind="1s"),
    "gentrades": lambda s, d: generate.trades(quotes(s, d).select(F.col("instr").alias("stream"), F.col("seq").alias("id")), seed=7),
}
