"""Named queries against their SQL twins at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import TINY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, TINY)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    key = lambda row: tuple((v is None, str(v)) for v in row)
    wanted = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=key)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert found == wanted


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
