"""Every catalogued query against its SQL in DuckDB, on the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

from pagewright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalog.SQL:
        assert got
        return
    found = con.execute(catalog.SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert len(at) == len(found.description)
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in found.fetchall())
