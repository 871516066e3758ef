"""Every library query with SQL, held against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidemark.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, oracle, name):
    got = QUERIES[name](spark, DATA)
    want = oracle.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_queries_without_sql_give_rows(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, DATA).limit(1).count() == 1, name
