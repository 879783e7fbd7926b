"""Every registered query of the core against its SQL, over the smallest tables."""

import os

import pytest

from millrace.plans import registry

D = "/root/testdata/sf0.001"


def compare(spark, queries, oracle, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{D}/{f}')")

    def norm(df):
        df = df[sorted(df.columns)]
        cell = lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else "null" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
        return list(df.columns), sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))

    assert norm(queries[name](spark, D).toPandas()) == norm(con.execute(oracle[name]).fetchdf())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    compare(spark, registry.queries(), registry.oracle_sql(), name)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, name):
    df = registry.queries()[name](spark, D)
    assert df.columns and df.count() >= 0
