import duckdb
import pytest

import __spark_entry__ as entry
from parcelyard.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shape(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_the_rows_of_its_sql(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    assert len(got)
    if name in queries.SQL:
        assert shape(got) == shape(duck.execute(queries.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
