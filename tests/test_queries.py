"""Every registered series query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from boundwave.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(r[i] for i in at) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in got.collect()]
    assert (rows or name == "density_filter_topk") and len(set(got.columns)) == len(got.columns)
    if name in registry.ORACLE_SQL:
        want = sql.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert plain(rows, got.columns, want.columns) == plain(want.fetchall(), want.columns, want.columns)
