"""The driver's contract, and every oracle at the smallest size."""

import importlib

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


def test_flagship(spark):
    assert set(entry.entry(spark).columns) == {"docid", "score"}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    shown = lambda x: "null" if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) else str(x)
    plain = lambda d: sorted(tuple(map(shown, r)) for r in d[columns].itertuples(index=False))
    assert plain(got) == plain(want)
