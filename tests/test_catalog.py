import os
import re

import duckdb
import pytest

import __spark_entry__
from foliant.plans import catalog

SF = os.environ.get("SQL_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.limit(1).count() == 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_large_tables_are_dealt_out_too(spark):
    """A table of 8 GB that is one part becomes parts of some MB, and a small one four parts a core."""
    def parts(df):
        return int(re.search(r"Repartition (\d+), true", catalog.spread(df)._jdf.queryExecution().optimizedPlan().toString())[1])

    assert parts(spark.range(0, 10**9, 1, 1)) > 1000
    assert parts(spark.range(0, 10, 1, 1)) == 4 * spark.sparkContext.defaultParallelism
