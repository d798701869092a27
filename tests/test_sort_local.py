"""The local sort of a whole table: partitions stay small as the table grows, and its check sees what is out of order."""

import pytest
from pipespark import queries
from pipespark.scratch import Workspace
from pyspark.sql import functions as F


@pytest.fixture
def kept(monkeypatch):
    """The tables written by queries."""
    tables, keep = [], Workspace.keep

    def noted(self, df, name):
        tables.append(keep(self, df, name))
        return tables[-1]

    monkeypatch.setattr(Workspace, "keep", noted)
    return tables


def written(spark, path, n):
    """n rows with 50 quantities and seven lines an order, in no order."""
    i = F.col("id")
    spark.range(0, n, 1, 3).select((i * 7919 % 50 + 1).cast("double").alias("l_quantity"), F.expr(f"id * 104729 % {n} div 7").alias("l_orderkey")).write.parquet(f"{path}/lineitem.parquet")
    return spark.read.parquet(f"{path}/lineitem.parquet").agg(F.count("*"), F.lit(0), F.sum("l_quantity")).first()


def sizes(table):
    return [r.n for r in table.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()]


def test_partitions_and_tasks_stay_small_on_a_larger_table(spark, tmp_path, kept):
    want = written(spark, tmp_path, 2_500_000)
    got = queries.sort_local(spark, str(tmp_path))
    assert tuple(got.first()) == tuple(want)
    assert max(sizes(kept[0])) <= 510_000 and sum(sizes(kept[0])) == 2_500_000  # before: 625,000, a fourth of any table
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()  # which puts several partitions into a task


def test_small_empty_and_equal_rows(spark, tmp_path, kept):
    for name, n in (("none", 0), ("one", 1), ("few", 5000)):
        want = written(spark, tmp_path / name, n)
        assert tuple(queries.sort_local(spark, str(tmp_path / name)).first()) == tuple(want)
    (tmp_path / "equal").mkdir()
    spark.range(0, 2_100_000, 1, 3).select(F.lit(1.0).alias("l_quantity"), F.lit(5).cast("bigint").alias("l_orderkey")).write.parquet(f"{tmp_path}/equal/lineitem.parquet")
    assert tuple(queries.sort_local(spark, str(tmp_path / "equal")).first()) == (2_100_000, 0, 2_100_000.0)
    assert max(sizes(kept[-1])) <= 510_000


def test_rows_out_of_order_are_counted(spark, tmp_path, kept, monkeypatch):
    written(spark, tmp_path, 6000)
    monkeypatch.setattr(queries, "PART_ROWS", 500)
    monkeypatch.setattr(queries.O, "sort_by_columns", lambda df, by: df)
    got = queries.sort_local(spark, str(tmp_path)).first().misplaced
    rows = [(r.at >> 33, -r.l_quantity, r.l_orderkey) for r in kept[0].orderBy("at").collect()]
    assert len({r[0] for r in rows}) == 12
    assert got == sum(a[0] == b[0] and a[1:] > b[1:] for a, b in zip(rows, rows[1:], strict=False)) > 1000
