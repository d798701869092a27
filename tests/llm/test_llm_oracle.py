import glob
import os

import duckdb
import pytest
from pipespark.llm import queries

SF = "/root/testdata/sf0.01"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, rel = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    assert {c: KINDS[t] for c, t in got.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    a = sorted(map(repr, (tuple(r) for r in got.select(*rel.columns).collect())))
    assert a == sorted(map(repr, rel.fetchall()))
