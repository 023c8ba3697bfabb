"""Every query against its SQL, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tarn.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    one = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = plain(got.select(*columns).collect())
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert rows == plain([tuple(r[i] for i in order) for r in want.fetchall()])
