"""Queries against their SQL on events with odd values: prices of 0, times that several rows share."""

import duckdb
import pytest

from tests.test_queries import rows
from tickspark import plans


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of 600 events; every 25th has the value 0, some share their time and instrument with the one before."""
    path, duck = tmp_path_factory.mktemp("odd"), duckdb.connect()
    # value: whole cents up to 9.46; ts: a step of 7 minutes, none for every 30th event
    duck.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01 00:00:10' + to_seconds(420 * (i - CASE WHEN i % 30 = 29 THEN 1 ELSE 0 END)) AS ts, i % 11 AS user_id,
  CASE WHEN i % 30 >= 28 THEN 'view' ELSE ['click', 'error', 'view'][1 + (i * 7) % 3] END AS event_type, CASE WHEN i % 25 = 3 THEN 0.0 ELSE ((i * 389) % 947) / 100.0 END AS value, '' AS properties
  FROM (SELECT unnest(range(600)) AS i)) TO '{path}/events.parquet'""")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return str(path), duck


def same(spark, odd, name):
    path, duck = odd
    got, want = plans.QUERIES[name](spark, path).toArrow(), duck.execute(plans.ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert rows(columns, got) == rows(columns, want)
    return want


def test_velocity_of_changes_at_one_time(spark, odd):
    want = same(spark, odd, "sea_profile_velo")
    assert float("inf") in want.column("mean").to_pylist()


@pytest.mark.parametrize("name", ["candle", "candle_day", "candle_all", "quodist", "quodist_arrays", "quodist_res1", "quodist_table", "quodist_time"])
def test_zero_is_a_price(spark, odd, name):
    same(spark, odd, name)


def test_zero_is_a_sample_of_a_sum(spark, odd):
    same(spark, odd, "loghist_sums")


def test_arrays_have_the_types_of_their_sql(spark, odd):
    path, duck = odd
    want = duck.execute(plans.ORACLES["quodist_arrays"]).to_arrow_table().schema
    got = plans.QUERIES["quodist_arrays"](spark, path).limit(0).toArrow().schema
    assert {n: got.field(n).type for n in ("bins", "filled", "places")} == {n: want.field(n).type for n in ("bins", "filled", "places")}
