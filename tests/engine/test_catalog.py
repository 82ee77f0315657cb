"""Every named query against its SQL, over the driver's smallest tables."""

import duckdb
import pytest

from skeinlake.catalog.all import ORACLES, QUERIES
from skeinlake.catalog.bindings import TABLES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(x):
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return tuple(map(_plain, x)) if isinstance(x, list) else x


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, key):
    df = QUERIES[key](spark, sf)
    cur = duck.execute(ORACLES[key])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    want = sorted((tuple(_plain(r[k]) for k in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(map(_plain, r)) for r in df.collect()), key=repr)
    assert got == want
    kinds = {r[0]: str(r[1]) for r in duck.execute("DESCRIBE " + ORACLES[key]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, key):
    assert QUERIES[key](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["section", "json"] and df.count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
