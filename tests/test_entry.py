"""The registered queries against their SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

from sylvan.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    got = con.execute(catalogue.ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v) for v in row)
    assert sorted(map(key, df.select(*names).collect())) == sorted(map(key, got.fetchall()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
