"""Every query with an SQL twin gives DuckDB's rows at sf0.001."""

import os

import duckdb
import pytest

from tallymark.plans import registry, resolution, state, wines  # noqa: F401

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in os.listdir(D):
        c.sql(f"create view {x.removesuffix('.parquet')} as select * from '{D}/{x}'")
    return c


def canonical(df):
    columns = sorted(df.columns)
    out = df[columns].apply(lambda q: q.astype(float).round(6) if q.dtype.kind in "iuf" else q.astype(str).str.removesuffix(" 00:00:00"))
    return out.astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, D).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert canonical(ours).equals(canonical(theirs))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
