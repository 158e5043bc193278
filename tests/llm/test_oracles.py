"""The training-data queries that SQL can express, against another engine on the same tables."""

import pytest

from waygrid.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.sql(queries.oracle_sql()[name])
    columns = sorted(found.columns)
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    at = [found.columns.index(x) for x in columns]
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_every_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in queries.queries()]
    assert sorted(numbers) == list(range(1, 11))
