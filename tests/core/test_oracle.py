"""Every query with a DuckDB twin gives its rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from timespan.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    def plain(x):
        if not hasattr(x, "__len__") and pd.isna(x):
            return "~"
        if isinstance(x, bool | np.bool_):
            return str(x)
        if isinstance(x, int | np.integer) or (isinstance(x, float) and x.is_integer()):  # a column with nulls holds integers as floats
            return str(int(x))
        return f"{float(x):.6g}" if hasattr(x, "__float__") and not isinstance(x, str) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, sf_dir, name):
    mine, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    assert rows(mine, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
