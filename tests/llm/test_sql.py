"""Corpus queries that SQL can express, against that SQL over whole tables."""

import duckdb
import pytest

from parcelyard.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    with duckdb.connect() as db:
        for table in TABLES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        cursor = db.execute(queries.SQL[name])
        columns = [c[0] for c in cursor.description]
        want = cursor.fetchall()
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(None if x != x else x for x in row) for row in got[columns].itertuples(index=False, name=None)]
    assert sorted(rows, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
