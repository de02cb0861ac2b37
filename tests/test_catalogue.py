import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from galley.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def shown(x):
    """A value as text; pandas makes whole numbers beside nulls floats."""
    return "" if x is None else repr(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(shown, r)) for r in df.where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert isinstance(got, pd.DataFrame)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
