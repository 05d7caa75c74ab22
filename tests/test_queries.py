"""Every query that has SQL gives the same rows in DuckDB; all others run."""

import math

import duckdb
import pytest

import __spark_entry__
from scholion import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    plain = lambda x: None if x is None or x != x else round(x, 9) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(plain(x) for x in r) for r in frame), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*columns).collect())
    if name in own.ORACLE:
        answer = duck.sql(own.ORACLE[name])
        assert sorted(answer.columns) == columns
        assert got == rows(answer.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(own.ORACLE) <= set(__spark_entry__.queries())
