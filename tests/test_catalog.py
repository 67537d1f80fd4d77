"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from siftwick import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(df, duck, sql):
    a, b = df.toPandas(), duck.sql(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def norm(x):
        return sorted(map(tuple, x[cols].astype(str).replace({"<NA>": "nan", "None": "nan"}).values.tolist()))

    assert norm(a) == norm(b)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        same(df, duck, sql)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 17
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
