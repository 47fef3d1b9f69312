"""Every query that has SQL gives DuckDB's rows."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = db.sql(SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(SQL) if not n.startswith("op") and n != "pipeline"))
def test_other_queries_run(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
