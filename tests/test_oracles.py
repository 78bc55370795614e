"""Every registered query with SQL against DuckDB over the same tables."""

import decimal
import os

import duckdb
import pytest

from corpusmill.plans import ORACLE, QUERIES

TABLES = "documents embeddings pages region nation customer supplier part orders lineitem events benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6g}" if not isinstance(v, int) or abs(v) < 1_000_000 else str(v)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got, names = df.collect(), df.columns
    cur = duck.execute(ORACLE[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(names) == sorted(theirs)
    order = sorted(names)
    a = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in got)
    b = sorted(tuple(plain(r[theirs.index(c)]) for c in order) for r in cur.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
