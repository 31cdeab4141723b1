"""Every query with an SQL equivalent against that SQL, over the smallest test tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def sql():
    import duckdb

    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    if name in entry.oracle_sql():
        relation = sql.sql(entry.oracle_sql()[name])
        assert sorted(relation.columns) == columns
        assert got == sorted((plain(r) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
