"""Every query against its SQL twin on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value if value is None or isinstance(value, (int, bool)) else str(value)


def rows(columns, found):
    return sorted(repr([v for _, v in sorted(zip(columns, map(plain, r)))]) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_like_sql(spark, con, name):
    frame = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, map(tuple, frame.collect())) == rows(columns, cursor.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
