"""Every registered query against its DuckDB text, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomspan.plans.catalog import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    def cell(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return "[" + ", ".join(map(cell, x)) + "]"
        if pd.isna(x):
            return "~"
        if type(x).__name__ in ("float", "float64", "Decimal"):
            x = round(float(x), 6)
            return str(int(x)) if x == int(x) else repr(x)
        return str(x)

    names = sorted(df.columns)
    return names, sorted(tuple(cell(x) for x in row) for row in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        assert plain(got) == plain(duck.sql(ORACLE[name]).df())
    else:
        assert len(got)
