"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from ebbmark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are needed")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    out = duck.execute(catalog.ORACLES[name])
    at = [[d[0] for d in out.description].index(c) for c in columns]
    assert len(at) == len(out.description)
    assert got == sorted(repr(tuple(plain(r[k]) for k in at)) for r in out.fetchall())
