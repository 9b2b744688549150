"""Every registered query of the graph engine against its SQL, at the smallest scale."""

import pytest

from quiverdf import queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels embeddings conversations events orders lineitem customer supplier part nation region".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert plain(got).equals(plain(want))
