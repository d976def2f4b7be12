"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(df, columns):
    def one(v):
        if v is None or str(v) in ("NaT", "<NA>") or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        try:
            return repr(float(v)) if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(one(v) for v in row) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert norm(got, columns) == norm(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
