"""Every query of the engine against its SQL over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.queries import QUERIES

DIR = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    r = db.sql(ORACLE[name])
    assert rows_of(df.columns, df.collect()) == rows_of(r.columns, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert len(rows) > 0


def test_names_agree():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
