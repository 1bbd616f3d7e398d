"""Every query against its SQL on the bench tables."""

import os

import duckdb
import pytest

from readlake.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no bench tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


def plain(x):
    return x if x is None or isinstance(x, (str, bool)) else round(float(x), 8)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    found = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
