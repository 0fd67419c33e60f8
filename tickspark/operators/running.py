"""Last known and previous values along a time-ordered stream, in two phases so that a single instrument can be spread.

A stream is cut into time slices. Within a slice a window gives the value; what a slice starts with is carried from the
slices before, over one row for each slice. A window of one task thus never holds more than a slice of an instrument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.timeunits import duration, whole

SLICE = "1d"

#: The least width of a time cell of ``xevent`` and ``rolling``, in nanoseconds: a cell's counts are a row in one task.
CELL = 600 * 10**9


def cut_at(df: DataFrame, every: str | int) -> DataFrame:
    """``df`` with ``_slice``: as it is where it has one (see ``slices.sliced``), else the stretch of time that a row lies in."""
    return df if "_slice" in df.columns else df.withColumn("_slice", whole(F.col("t"), duration(every)))


def last_known(df: DataFrame, values: dict[str, Column], by: list[str], own: bool = True, every: str | int = SLICE, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """``df`` with, for each name, the last non-null value of the column so far in ``by``; own: the row itself included."""
    keys = [*by, "_slice"]
    cut = cut_at(df, every).select("*", *(v.alias(f"_v_{n}") for n, v in values.items()))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    seen = cut.select("*", *(F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_in_{n}") for n in values))
    at = F.struct(*order)
    ends = cut.groupBy(*keys).agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_end_{n}") for n in values))
    over = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, *(F.last(f"_end_{n}", ignorenulls=True).over(over).alias(f"_from_{n}") for n in values))
    joined = seen.join(carried, keys)
    return joined.select(*df.columns, *(F.coalesce(f"_in_{n}", f"_from_{n}").alias(n) for n in values))


def previous(df: DataFrame, columns: dict[str, str], by: list[str], every: str | int = SLICE) -> DataFrame:
    """``df`` with the columns of the row before, as structs so that their nulls stay apart from no row at all."""
    named = last_known(df, {"_before": F.struct(*dict.fromkeys(columns.values()))}, by, own=False, every=every)
    return named.select(*df.columns, *(F.col(f"_before.{c}").alias(n) for n, c in columns.items()))


def lately(df: DataFrame, columns: list[str], n: int, by: list[str], every: str | int = SLICE) -> DataFrame:
    """``df`` with ``_back``, the given columns of up to ``n`` rows before as structs, the nearest one last: one pass for several
    lags. A slice carries its last ``n`` rows; as each slice has a row, ``n`` slices back are enough."""
    keys, row = [*by, "_slice"], F.struct(*columns)
    cut = cut_at(df, every).withColumn("_row", row)
    inside = Window.partitionBy(*keys).orderBy("t", "seq")
    seen = cut.withColumn("_in", F.collect_list("_row").over(inside.rowsBetween(-n, -1))).withColumn("_to_go", F.row_number().over(inside.orderBy(F.desc("t"), F.desc("seq"))))
    ends = seen.where(F.col("_to_go") <= n).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "seq", F.col("_row").alias("x")))).alias("_ends"))
    over = Window.partitionBy(*by).orderBy("_slice").rowsBetween(-n, -1)
    carried = ends.select(*keys, F.flatten(F.collect_list(F.transform("_ends", lambda e: e["x"])).over(over)).alias("_from"))
    both = F.concat("_from", "_in")
    return seen.join(carried, keys).select(*df.columns, F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n)).alias("_back"))


def extremes_before(df: DataFrame, low: dict[str, str], high: dict[str, str], by: list[str], every: str | int = SLICE, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """``df`` with the least (low) and largest (high) values of columns over all rows before in ``by``, slice by slice."""
    keys = [*by, "_slice"]
    cut = cut_at(df, every)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    kinds = [(F.min, F.least, n, c) for n, c in low.items()] + [(F.max, F.greatest, n, c) for n, c in high.items()]
    seen = cut.select("*", *(f(c).over(inside).alias(f"_in_{n}") for f, _, n, c in kinds))
    ends = cut.groupBy(*keys).agg(*(f(c).alias(f"_end_{n}") for f, _, n, c in kinds))
    carried = ends.select(*keys, *(f(f"_end_{n}").over(over).alias(f"_from_{n}") for f, _, n, _ in kinds))
    return seen.join(carried, keys).select(*df.columns, *(two(f"_in_{n}", f"_from_{n}").alias(n) for _, two, n, _ in kinds))


def running_sums(df: DataFrame, values: dict[str, Column], by: list[str], every: str | int = SLICE) -> DataFrame:
    """``df`` with, for each name, the sum of its value over all rows so far in ``by``: within the slice, plus the slices before."""
    keys = [*by, "_slice"]
    cut = cut_at(df, every).withColumns({f"_value_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*keys).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys).agg(*(F.sum(f"_value_{n}").alias(f"_all_{n}") for n in values)).select(*keys, *(F.sum(f"_all_{n}").over(over).alias(f"_before_{n}") for n in values))
    seen = cut.select("*", *(F.sum(f"_value_{n}").over(inside).alias(f"_in_{n}") for n in values))
    return seen.join(before, keys).select(*df.columns, *((F.col(f"_in_{n}") + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in values))


def running_sum(df: DataFrame, name: str, value: Column, by: list[str], every: str | int = SLICE) -> DataFrame:
    return running_sums(df, {name: value}, by, every)


def following(df: DataFrame, columns: dict[str, str], by: list[str], every: str | int = SLICE) -> DataFrame:
    """``df`` with the columns of the row after: the row before in reversed time."""
    turned = lambda d: d.withColumns({c: -F.col(c) for c in ("t", "seq", "_slice") if c in d.columns})
    kept = {f"_kept_{n}": F.col(c) for n, c in columns.items()}  # their own values, as t and seq are turned
    return turned(previous(turned(df.withColumns(kept)), {n: f"_kept_{n}" for n in columns}, by, every)).drop(*kept)


def overlapping(df: DataFrame, back: int, every: str | int = SLICE) -> DataFrame:
    """``df`` with ``_slice`` and ``_own``: each row in its own time slice and again, not ``_own``, in the next one if that
    looks back on it over ``back`` nanoseconds. Slices are at least that wide, so range windows can run within a slice."""
    width = max(duration(every), back + 1)
    own = whole(F.col("t"), width)
    next_one = F.when(F.col("t") + back >= (own + 1) * width, own + 1)
    rows = df.withColumn("_slice", F.explode(F.array_compact(F.array(own, next_one))))
    return rows.withColumn("_own", F.col("_slice") == whole(F.col("t"), width))


def numbered(df: DataFrame, by: list[str], every: str | int = SLICE) -> DataFrame:
    """``df`` with ``_n``, each row's number from 1 in its stream: its place within a slice plus the counts of those before."""
    keys = [*by, "_slice"]
    cut = cut_at(df, every)
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "seq"))
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    over = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, F.coalesce(F.sum("_size").over(over), F.lit(0)).alias("_before"))
    return cut.withColumn("_in", inside).join(before, keys).select(*df.columns, (F.col("_in") + F.col("_before")).cast("long").alias("_n"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt over all shuffle partitions by their keys, once: windows and joins on these keys take them as they lie.

    The number of partitions is fixed: where more comes out of a task than goes into it, Spark would choose too few.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def asof(left: DataFrame, right: DataFrame, columns: list[str], by: list[str], every: str | int = SLICE, strict: bool = False) -> DataFrame:
    """``left`` with the columns of the last row of ``right`` at or before its time (before it, if strict); null if none.

    Both have t and seq; of rows of one time the last by seq counts.
    """
    held = F.struct(*columns)
    a = left.withColumn("_held", F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType)).withColumn("_rank", F.lit(0 if strict else 2))
    b = right.select(*by, "t", "seq", held.alias("_held"), F.lit(1).alias("_rank"))
    known = last_known(a.unionByName(b, allowMissingColumns=True), {"_found": F.col("_held")}, by, every=every, order=("t", "_rank", "seq"))
    return known.where("_rank <> 1").select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in columns))
