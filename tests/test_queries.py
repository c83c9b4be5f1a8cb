"""Every registered query against its SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from cellweft.plans import catalogue
from tools.check_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in sorted(pathlib.Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert set(catalogue.queries()) <= set(names)


def test_entry(spark):
    assert entry.entry(spark).count() == 8


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in cursor.description], cursor.fetchall())
