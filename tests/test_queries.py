import duckdb
import pytest

from palimpsest.plans import lifecycle, queries

QUERIES, ORACLE_SQL = queries.QUERIES | lifecycle.QUERIES, queries.ORACLE_SQL | lifecycle.ORACLE_SQL
DATA = "/root/testdata/sf0.001"


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(columns, want.fetchall())
