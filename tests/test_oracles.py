"""Every registered query with a DuckDB statement returns the same rows, names and types as it."""

from pathlib import Path

import duckdb
import pytest

from fieldglass import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_its_statement(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(registry.oracles()[name])
    names, kinds = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == {n: k.replace("STRING", "VARCHAR") for n, k in zip(names, kinds, strict=True)}
    assert rows(df.columns, got) == rows(names, cur.fetchall())
