"""Every query that has SQL against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest
from pipespark import queries

SF = "/root/testdata/sf0.01"


def rounded(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert {c: KINDS[t] for c, t in got.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    order = sorted(got.columns)
    a = sorted((tuple(rounded(r[c]) for c in order) for r in got.collect()), key=repr)
    b = sorted((tuple(map(rounded, r)) for r in rel.select(*[f'"{c}"' for c in order]).fetchall()), key=repr)
    assert len(a) == len(b)
    assert a == b
