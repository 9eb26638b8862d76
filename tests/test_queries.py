"""Every registered query against its SQL twin, or for rows where there is none, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillgrid import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (str, int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        assert columns
        return
    got = duck.sql(SQL[name])
    assert sorted(got.columns) == columns
    kinds = dict(zip(got.columns, map(str, got.types), strict=True))
    theirs = sorted((tuple(plain(dict(zip(got.columns, r, strict=True))[c]) for c in columns) for r in got.fetchall()), key=str)
    assert ours == theirs
    for c, kind in df.dtypes:
        assert kinds[c] == KINDS.get(kind, kinds[c]), c


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
