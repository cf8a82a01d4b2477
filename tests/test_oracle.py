"""Every query with oracle SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'").fetchall()
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_agrees_with_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalog.ORACLE[name])
    names = [x[0] for x in cur.description]
    rows = cur.fetchall()
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rows)


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(entry.__file__)
