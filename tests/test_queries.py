"""Every registered query runs, and equals its SQL where it has any."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LATER = [q for q in QUERIES if q == "pipeline" or q.startswith("op") and q[2].isdigit() and q not in SQL]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(LATER)))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
