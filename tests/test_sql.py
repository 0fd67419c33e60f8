"""Operators as table functions of SQL: the rows of the operators, edge ticks, zero bids and missing values included."""

import random
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from tickspark import sql
from tickspark.operators import folds, resample, smooth

SECOND = 10**9
SCHEMA = "t long, seq long, instr string, bid decimal(18,2), ask decimal(18,2), bsz decimal(20,6), asz decimal(20,6)"


@pytest.fixture(scope="module")
def quotes(spark):
    rng, rows, t = random.Random(2), [], 100 * SECOND
    for i in range(160):
        t += rng.choice([0, 1, 3, 5, 20]) * SECOND  # many on edges of five seconds
        bid = rng.randrange(100, 140)
        side = lambda x: None if rng.random() < 0.05 else Decimal(0) if rng.random() < 0.05 else Decimal(x)
        size = None if rng.random() < 0.1 else Decimal(rng.randrange(1, 9))
        rows.append((t, i, rng.choice(["a", "b", None]) if i % 9 == 0 else rng.choice("ab"), side(bid), side(bid + rng.randrange(1, 5)), size, Decimal(3)))
    df = spark.createDataFrame([r for r in rows if r[2]], SCHEMA).repartition(3)
    df.createOrReplaceTempView("some_quotes")
    sql.operators(spark)
    return df


def same(got, want):
    assert got.columns == want.columns
    cell = lambda x: round(float(x), 9) if isinstance(x, (Decimal, float)) else x
    rows = [sorted((tuple(map(cell, r)) for r in df.collect()), key=repr) for df in (got, want)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("every", ["5s", "20s", "1m"])
def test_candles_follow_the_window_rule(spark, quotes, every):
    same(spark.sql(f"SELECT * FROM candle(TABLE(some_quotes), '{every}')"), resample.candle(quotes, every))


def test_a_row_on_an_edge_ends_the_open_window(spark, quotes):
    rows = [(SECOND * t, i, "x", Decimal(b), Decimal(b + 1), None, None) for i, (t, b) in enumerate([(1, 5), (5, 6), (10, 7), (11, 0), (15, 8), (20, 9)])]
    spark.createDataFrame(rows, SCHEMA).createOrReplaceTempView("edges")
    got = spark.sql("SELECT cndl, _1st div 1000000000 AS first, last div 1000000000 AS last FROM candle(TABLE(edges), '5s') ORDER BY cndl")
    assert sorted(tuple(r) for r in got.collect()) == [("15.000000000", 10, 15), ("25.000000000", 20, 20), ("5.000000000", 1, 5)]


def test_moves_and_turns(spark, quotes):
    valid = "TABLE(SELECT * FROM some_quotes WHERE bid > 0 AND ask > 0)"
    given = quotes.where("bid > 0 and ask > 0")
    columns = ["t", "seq", "instr", "bid", "ask"]
    same(spark.sql(f"SELECT * FROM moves({valid}, '7.5')"), folds.qq(given, "7.5").select(columns))
    same(spark.sql("SELECT * FROM moves(TABLE(some_quotes), NULL)"), folds.qq(quotes).select(columns))
    same(spark.sql(f"SELECT * FROM turns({valid}, '5')"), folds.opt(given, "5", limit_orders=True))


def test_weighted_means(spark, quotes):
    want = smooth.ewma(quotes, ["ask"], "1m", by=["instr"]).withColumnsRenamed({"ask_mean": "mean", "ask_dev": "dev"})
    same(spark.sql("SELECT * FROM weighted(TABLE(some_quotes), 'ask', '1m')"), want)


def test_a_table_without_the_columns_is_refused(spark, quotes):
    with pytest.raises(PySparkException, match="instr"):
        spark.sql("SELECT * FROM candle(TABLE(SELECT 1 AS t, 2 AS seq), '5s')").collect()
