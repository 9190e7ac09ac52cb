"""Every query with SQL gives the rows of that SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_random_sample_is_repeatable_and_distinct(spark, sf):
    a = entry.queries()["random_sample"](spark, sf).collect()
    b = entry.queries()["random_sample"](spark, sf).collect()
    assert a == b and len({r.doc_id for r in a}) == 50
