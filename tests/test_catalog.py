"""Every registered query of the engine against its oracle in SQL."""

import os

import duckdb
import pandas as pd
import pytest

from skein import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, (int, bool)) or (isinstance(v, float) and v == int(v)) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    if name not in catalog.oracle_sql():
        assert got.count() > 0
        return
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.toPandas()) == _rows(want)
    assert len(want)
