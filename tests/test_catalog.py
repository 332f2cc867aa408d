"""Every registered query of the engine against its SQL in DuckDB, on the smallest driver tables."""

import os

import duckdb
import pytest

from tessera import catalog

FOLDER = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, key):
    df = catalog.QUERIES[key](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert key in catalog.ORACLES
    want = duck.sql(catalog.ORACLES[key])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())
