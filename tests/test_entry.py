import duckdb
import pytest

import __spark_entry__ as e
from loomtext import queries

DIR = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, DIR)
    c = duckdb.connect()
    for t in ("part", "events", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    r = c.execute(queries.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(norm(x[n]) for n in names) for x in got.collect()), key=key) == sorted((tuple(map(norm, x)) for x in r.fetchall()), key=key)


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
