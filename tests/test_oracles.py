"""Every query with SQL gives that SQL's rows, on the smallest data."""

import decimal

import duckdb
import pytest

from quarry import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    r = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    ours = sorted(repr([plain(x[c]) for c in sorted(df.columns)]) for x in df.collect())
    at = [r.columns.index(c) for c in sorted(r.columns)]
    assert ours == sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())


def test_queries_without_sql_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, DATA).limit(5).collect() is not None
