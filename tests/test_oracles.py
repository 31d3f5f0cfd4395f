"""Every registered query of the library against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quotelens.oracles import oracle_sql
from quotelens.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(df):
    df = df.astype(object)[sorted(df.columns)]
    cell = lambda v: "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(queries()))
def test_same_rows(spark, duck, name):
    assert plain(queries()[name](spark, SF).toPandas()) == plain(duck.sql(oracle_sql()[name]).df())
