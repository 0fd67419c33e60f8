"""Tick records: reading and printing tab-separated lines, and quote views of the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.timeunits import format_stamp, parse_stamp
from tickspark.sources import lines

#: Order verbs by first letter.
VERBS = {"L": "LONG", "S": "SHORT", "C": "CANCEL", "E": "CANCEL"}


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select("seq", F.split("value", "\t").alias("f"), "path")


def read_lines(spark: SparkSession, *paths: str, split: int = lines.RANGE) -> DataFrame:
    """(seq, f, path): the fields of each line, and a number that grows in the order of files and lines, the same however files
    are split (see ``lines``)."""
    spark.dataSource.register(lines.Lines)
    return _fields(spark.read.format("ticklines").option("paths", json.dumps(list(paths))).option("range", split).load())


def stream_lines(spark: SparkSession, path: str, split: int = lines.RANGE, settle: float = 1) -> DataFrame:
    """``read_lines`` of the files that come into a folder, as a stream."""
    spark.dataSource.register(lines.Lines)
    return _fields(spark.readStream.format("ticklines").option("range", split).option("settle", settle).load(path))


def any_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """As ``read_lines``, of paths that only Spark opens; seq grows within a task's part of a file and is not the same at each
    size of a split."""
    return spark.read.text(list(paths)).select(F.monotonically_increasing_id().alias("seq"), F.split("value", "\t").alias("f"), F.col("_metadata.file_path").alias("path"))


def field(i: int) -> Column:
    return F.nullif(F.get("f", F.lit(i)), F.lit(""))


def read_quotes(spark: SparkSession, *paths: str) -> DataFrame:
    """t, seq, instr, bid, ask, bsz, asz, path; lines without a stamp are left out, a missing price is null."""
    return quotes_of(read_lines(spark, *paths))


def stream_quotes(spark: SparkSession, path: str, **how) -> DataFrame:
    """``read_quotes`` of the files that come into a folder, as a stream."""
    return quotes_of(stream_lines(spark, path, **how))


def quotes_of(read: DataFrame) -> DataFrame:
    """Quotes from the fields of lines."""
    number = lambda i, kind: field(i).try_cast(kind)
    return read.select(parse_stamp(field(0)).alias("t"), "seq", F.coalesce(field(1), F.lit("")).alias("instr"), number(2, "decimal(18,9)").alias("bid"), number(3, "decimal(18,9)").alias("ask"), number(4, "decimal(20,6)").alias("bsz"), number(5, "decimal(20,6)").alias("asz"), "path").where("t is not null")


def read_orders(spark: SparkSession, *paths: str) -> DataFrame:
    """t, seq, side, instr, limit_px, target_px, stop_px; other verbs are left out, MKT stands for no limit."""
    side = F.coalesce(*(F.when(field(1).startswith(k), F.lit(v)) for k, v in VERBS.items()))
    rows = read_lines(spark, *paths).select(parse_stamp(field(0)).alias("t"), "seq", side.alias("side"), field(2).alias("instr"), *(field(i).try_cast("decimal(18,9)").alias(n) for i, n in ((3, "limit_px"), (4, "target_px"), (5, "stop_px"))))
    return rows.where("t is not null and side is not null")


def read_accounts(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(accounts, executions) of files that hold ACC, EXE and REJ lines; other verbs are left out."""
    rows = read_lines(spark, *paths).withColumn("verb", field(1)).withColumn("t", parse_stamp(field(0))).where("t is not null")
    number = lambda i: field(i).try_cast("decimal(28,7)")
    accounts = rows.where("verb = 'ACC'").select("t", "seq", F.coalesce(field(2), F.lit("")).alias("instr"), *(number(i).alias(n) for i, n in ((3, "base"), (4, "term"), (5, "comb"), (6, "comt"))))
    execs = rows.where("verb = 'EXE'").select("t", "seq", F.coalesce(field(2), F.lit("")).alias("instr"), *(number(i).alias(n) for i, n in ((3, "qty"), (4, "px"), (5, "spread"))))
    return accounts, execs


def read_stamps(spark: SparkSession, *paths: str) -> DataFrame:
    """t: evaluation times, one a line."""
    return read_lines(spark, *paths).select(parse_stamp(field(0)).alias("t")).where("t is not null")


def read_forwards(spark: SparkSession, *paths: str) -> DataFrame:
    """t, seq, fwd_id, underlying, bid, ask: forward points."""
    return read_lines(spark, *paths).select(parse_stamp(field(0)).alias("t"), "seq", field(1).alias("fwd_id"), field(2).alias("underlying"), *(field(i).try_cast("decimal(18,9)").alias(n) for i, n in ((3, "bid"), (4, "ask")))).where("t is not null")


def write_profile(profile: DataFrame, path: str, mode: str, modulus: int, width: int) -> None:
    """A seasonality profile as lines: mode, modulus and width; then n, mean, var of each bin in order, the overall row last.

    A profile has one row for each bin, so its order is made in one task.
    """
    head = profile.sparkSession.createDataFrame([(-2, f"{mode}\t{modulus}\t{width}")], "at long, value string")
    last = F.when(F.col("bin") < 0, F.lit(2**62)).otherwise(F.col("bin"))
    body = profile.select(last.alias("at"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n", "mean", "var"))).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)


def read_profile(spark: SparkSession, path: str) -> tuple[DataFrame, str, int, int]:
    """(profile, mode, modulus, width) of a written profile; the overall row has bin -1."""
    mode, modulus, width = spark.read.text(path).first()[0].split("\t")
    n = int(modulus) // int(width)
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("at", "line")).where("at > 0 and line <> ''")
    cell = lambda i: F.split_part(F.col("line"), F.lit("\t"), F.lit(i))
    return rows.select(F.when(F.col("at") > n, -1).otherwise(F.col("at") - 1).cast("long").alias("bin"), cell(1).cast("long").alias("n"), cell(2).try_cast("double").alias("mean"), cell(3).try_cast("double").alias("var")), mode, int(modulus), int(width)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks of events, a folder each, named by number."""
    chunks.write.partitionBy("chunk").parquet(path)


def format_tsv(df: DataFrame, *columns: str, stamp: str | None = "t") -> DataFrame:
    """One text column: the fields tab-separated, the stamp with nine decimals, nulls empty. The sink is ``write.text``."""
    cells = [format_stamp(F.col(c)) if c == stamp else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def write_tsv(df: DataFrame, path: str, *columns: str, stamp: str | None = "t") -> None:
    format_tsv(df, *columns, stamp=stamp).write.text(path)


def event_time(ts: str = "ts") -> Column:
    """Nanoseconds of a timestamp column."""
    return F.unix_micros(F.col(ts).cast("timestamp")) * 1000


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as quotes: an instrument for each event type, ask above bid by one to four cents."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bid = F.col("value").cast("decimal(18,2)")
    ask = (bid + (1 + F.col("event_id") % 4).cast("decimal(10,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")
    return events.select(event_time().alias("t"), F.col("event_id").alias("seq"), F.col("event_type").alias("instr"), bid.alias("bid"), ask.alias("ask"), (1 + F.col("user_id") % 7).cast("decimal(20,6)").alias("bsz"), (1 + F.col("event_id") % 5).cast("decimal(20,6)").alias("asz"))


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an order, by its number: LONG, SHORT, LONG, CANCEL; one in three that isn't a CANCEL has a limit at its bid."""
    quotes = event_quotes(spark, sf_dir)
    side = F.element_at(F.array(*(F.lit(x) for x in ("LONG", "SHORT", "LONG", "CANCEL"))), (F.col("seq") % 4 + 1).cast("int"))
    none = F.lit(None).cast("decimal(18,9)")
    limit = F.when((F.col("seq") % 3 == 0) & (F.col("seq") % 4 != 3), F.col("bid").cast("decimal(18,9)"))
    return quotes.withColumn("side", side).select("t", "seq", "side", "instr", limit.alias("limit_px"), none.alias("target_px"), none.alias("stop_px"))


def split_files(quotes: DataFrame, files: int) -> list[DataFrame]:
    """Quotes dealt to several sources by sequence number, as if each were a file."""
    return [quotes.where(F.pmod("seq", F.lit(files)) == i) for i in range(files)]


