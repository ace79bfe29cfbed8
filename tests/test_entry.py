import duckdb
import pytest

import __spark_entry__ as entry
from threadloom import plans
from threadloom.session import TABLES

DATA = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_query_agrees_with_its_sql(spark, name):
    df = plans.all_queries()[name](spark, DATA).toPandas()
    sql = plans.all_sql().get(name)
    if sql is None:
        assert len(df)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    key = lambda d: sorted(map(repr, d[columns].itertuples(index=False, name=None)))
    assert key(df) == key(want)
