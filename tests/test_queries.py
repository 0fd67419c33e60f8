"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tickspark import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def cell(v):
    if v is None or v != v:
        return ""
    return round(float(v), 6) if isinstance(v, (bool, int, float)) or hasattr(v, "dtype") else str(v)


def rows(columns, table):
    return sorted((tuple(map(cell, r)) for r in zip(*(table.column(c).to_pylist() for c in columns), strict=True)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DATA).toArrow(), duck.execute(plans.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(got.column_names)
    assert rows(columns, got) == rows(columns, want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
