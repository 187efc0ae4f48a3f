"""Every query with an oracle equals DuckDB on the same tables."""
import math

import duckdb
import pytest

from assayframe import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    expected = rows(columns, want.fetchall())
    assert sorted(got.columns) == sorted(columns)
    actual = rows(got.columns, [tuple(r) for r in got.collect()])
    assert len(actual) == len(expected)
    for a, b in zip(actual, expected):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
