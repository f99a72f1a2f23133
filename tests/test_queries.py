"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from wardscribe.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)]
    show = lambda v: "null" if pd.isna(v) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    a, b = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert plain(a) == plain(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
