"""The queries that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from lodestone.llm import queries

DATA = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


def table(names, rows):
    """Columns by name; floats to six digits, whole numbers as such."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: f"{x:.6g}" if isinstance(x, float) else x
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(SQL[name])
    df = queries.queries()[name](spark, DATA)
    assert table(df.columns, df.collect()) == table([c[0] for c in want.description], want.fetchall())
