"""Account algebra: realised profit by position segment, and trade statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.functions.timeunits import duration
from tickspark.operators.running import last_known, lately, previous, running_sum

KIND = "decimal(38,12)"


def _kept(accounts: DataFrame, execs: DataFrame | None, gross: int, by: list[str]) -> DataFrame:
    """Account rows whose base differs from the row before (0 before the first), with comm (and sprd) beside base and term."""
    comm = F.lit(0).cast(KIND) if gross else (F.col("comb") + F.col("comt")).cast(KIND)
    rows = accounts.select(*by, "t", "seq", "base", F.col("term").cast("decimal(28,7)").alias("term"), comm.alias("comm"))
    if gross > 1 and execs is not None:
        paid = F.abs(F.col("qty")) * F.col("spread") / 2
        costs = running_sum(execs, "_paid", F.coalesce(paid, F.lit(0)), by).select(*by, "t", "seq", F.col("_paid").cast(KIND).alias("_cost"), F.lit(0).alias("_acc"))
        both = rows.withColumn("_acc", F.lit(1)).unionByName(costs, allowMissingColumns=True)
        # an execution comes before the account of the same time and number
        known = last_known(both, {"sprd": F.col("_cost")}, by, order=("t", "seq", "_acc")).where("_acc = 1")
        rows = known.withColumn("sprd", F.coalesce("sprd", F.lit(0).cast(KIND))).drop("_acc", "_cost")
    else:
        rows = rows.withColumn("sprd", F.lit(0).cast(KIND))
    before = previous(rows, {"_base": "base"}, by)
    return before.where("base <> coalesce(_base, 0)").drop("_base")


def segments(accounts: DataFrame, execs: DataFrame | None = None, gross: int = 0, edge: bool = False, by: list[str] | None = None) -> DataFrame:
    """A row for each change of position: t, since (the change before), old and new side (F, L, S), and realised amounts.

    At each change the levels (the amounts at which the line between both rows crosses base 0) of term, commission and
    spread are taken; their change since the last level is what the segment realised. edge: sides by the change of base.
    """
    by = ["instr"] if by is None else by
    kept = _kept(accounts, execs, gross, by)
    amounts = ("base", "term", "comm", "sprd")
    at = lately(kept, ["t", *amounts], 2, by).select("*", F.try_element_at("_back", F.lit(-1)).alias("one"), F.try_element_at("_back", F.lit(-2)).alias("two"))
    zero = F.lit(0).cast("decimal(28,7)")
    of = lambda row, c: F.coalesce(F.col(f"{row}.{c}"), zero) if row else F.col(c)

    def level(row: str, before: str) -> Column:
        """Where the line between two rows crosses base 0, for each amount."""
        b, b0 = of(row, "base"), of(before, "base")
        crossed = [(of(row, c).cast("double") * b0.cast("double") - b.cast("double") * of(before, c).cast("double")) / (b0 - b).cast("double") for c in amounts[1:]]
        return crossed[0] + crossed[1] + crossed[2]

    old = F.when(F.col("one").isNotNull(), of("one", "base") - of("two", "base")) if edge else of("one", "base")
    what = F.col("base") - of("one", "base") if edge else F.col("base")
    side = lambda x: F.when(x > 0, "L").when(x < 0, "S").otherwise("F")
    realised = F.round(level("", "one") - F.when(F.col("one").isNull(), 0.0).otherwise(level("one", "two")), 6)
    return at.select(*by, "t", "seq", F.coalesce("one.t", "t").alias("since"), side(F.coalesce(old, zero)).alias("old"), side(what).alias("new"), of("one", "base").alias("base"), realised.alias("rpnl"))


def flows(accounts: DataFrame, execs: DataFrame | None, edge: bool, gross: int, by: list[str]) -> DataFrame:
    """What the segments from each side to each side add up to: at most nine rows a stream, of which all statistics are made."""
    gain = F.col("rpnl").cast("decimal(28,6)")  # exact, so that the order of rows doesn't matter
    return segments(accounts, execs, gross, edge, by).groupBy(*by, "old", "new").agg(F.count(F.lit(1)).alias("n"), F.sum((gain > 0).cast("long")).alias("hits"), F.sum(F.col("t") - F.col("since")).alias("time"), F.sum(gain).alias("rpnl"), F.sum(F.greatest(gain, F.lit(0).cast("decimal(28,6)"))).alias("rp"), F.sum(F.least(gain, F.lit(0).cast("decimal(28,6)"))).alias("rl"), F.max(gain).alias("best"), F.min(gain).alias("worst"))


def accsum(accounts: DataFrame, execs: DataFrame | None = None, edge: bool = False, gross: int = 0, by: list[str] | None = None) -> DataFrame:
    """Statistics of the sides F, L and S: hits, count of entries, time held, realised amounts and their extremes."""
    by = ["instr"] if by is None else by
    return _by_side(flows(accounts, execs, edge, gross, by), by)


def _by_side(flown: DataFrame, by: list[str]) -> DataFrame:
    sums = ("hits", "time", "rpnl", "rp", "rl")
    kinds = {f.name: f.dataType for f in flown.schema}
    held = F.struct(F.col("old").alias("side"), *sums, "best", "worst", F.lit(0).cast("long").alias("count"))
    entered = F.struct(F.col("new").alias("side"), *(F.lit(None).cast(kinds[c]).alias(c) for c in (*sums, "best", "worst")), F.col("n").alias("count"))
    keys = [*by, "side"]
    out = flown.select(*by, F.inline(F.array(held, entered))).groupBy(*keys).agg(*(F.sum(c).cast("double" if c.startswith("r") else "long").alias(c) for c in (*sums, "count")), F.max("best").cast("double").alias("best"), F.min("worst").cast("double").alias("worst"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    n = F.nullif("count", F.lit(0))
    return out.select(*keys, zero("hits"), zero("count"), zero("time"), *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("rpnl", "rp", "rl")), F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"), F.round(F.coalesce("rpnl", F.lit(0.0)) / n, 6).alias("avg"))


def accsum_report(accounts: DataFrame, execs: DataFrame | None = None, edge: bool = False, gross: int = 0, by: list[str] | None = None) -> DataFrame:
    """Rows L, S and L+S: hit rate, mean gain of hits, mean loss of the others, sums; and the counts and hits of changes from
    each side to each side (as cnt_FL, hit_LS, ...), repeated for each row."""
    by = ["instr"] if by is None else by
    flown = flows(accounts, execs, edge, gross, by)
    stats = _by_side(flown, by).where("side <> 'F'")
    both = stats.groupBy(*by).agg(F.lit("L+S").alias("side"), *(F.sum(c).alias(c) for c in ("hits", "count", "time")), *(F.round(F.sum(c), 6).alias(c) for c in ("rpnl", "rp", "rl")), F.max("best").alias("best"), F.min("worst").alias("worst"))
    rows = stats.drop("avg").unionByName(both)
    n, misses = F.nullif("count", F.lit(0)), F.nullif(F.col("count") - F.col("hits"), F.lit(0))
    moved = lambda a, b, c: F.coalesce(F.sum(F.when((F.col("old") == a) & (F.col("new") == b), F.col(c))), F.lit(0))
    moves = flown.groupBy(*by).agg(*(moved(a, b, c).alias(f"{name}_{a}{b}") for name, c in (("cnt", "n"), ("hit", "hits")) for a in "FLS" for b in "FLS"))
    ratio = lambda a, b: F.round(a / b, 6)
    out = rows.select("*", ratio(F.col("rpnl"), n).alias("avg"), ratio(F.col("hits"), n).alias("hit_r"), ratio(F.col("rp"), F.nullif("hits", F.lit(0))).alias("hit_sk"), ratio(F.col("rl"), misses).alias("loss_sk"))
    return out.join(moves, by) if by else out.crossJoin(F.broadcast(moves))


def accsum_table(report: DataFrame, by: tuple[str, ...] = ("instr",)) -> DataFrame:
    """The report in flat form: key (side and statistic) and value."""
    values = [c for c in report.columns if c not in (*by, "side")]
    pairs = F.array(*(F.struct(F.concat_ws(" ", F.col("side"), F.lit(c)).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in values))
    return report.select(*by, F.inline(pairs))


def accrpl(accounts: DataFrame, execs: DataFrame | None = None, gross: int = 0, rewind: str | int = 0, by: list[str] | None = None) -> DataFrame:
    """Realised amount and time of each closed segment of a position, stamped with its start less ``rewind``."""
    by = ["instr"] if by is None else by
    seg = segments(accounts, execs, gross, False, by).where("old <> 'F'")
    return seg.select((F.col("since") - duration(rewind)).alias("t"), "seq", *by, F.round("rpnl", 2).alias("rpnl"), (F.col("t") - F.col("since")).alias("exposure"))


