import random

import pytest
from pipespark import operators as O  # noqa: E741
from pipespark.errors import ConfigError, SchemaError
from pipespark.functions.stats import ColumnStats, collect_stats, profile
from pipespark.operators import WindowFunction
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.collect()]


def same(got, want):
    key = lambda r: [(x is not None, str(type(x)), x) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)


# Project and rename


def test_project_and_map(spark):
    df = spark.createDataFrame([(1, "A", 1.5), (2, "B", 2.5)], "col1 long, col2 string, col3 double")
    assert rows(O.project(df, ["col3", "col1"])) == [(1.5, 1), (2.5, 2)]
    assert O.project(df, []).columns == df.columns
    assert rows(O.project(df, ["col1", "col3 * 2 AS twice"])) == [(1, 3.0), (2, 5.0)]
    assert O.map_columns(df, "col1 AS id, col2").columns == ["id", "col2", "col3"]
    assert O.map_columns(df, {"col2": "name"}).columns == ["col1", "name", "col3"]
    assert O.map_columns(df, "col1 AS col2, col2 as col1").columns == ["col2", "col1", "col3"]
    for bad in (lambda: O.project(df, ["nope"]), lambda: O.map_columns(df, "nope AS x")):
        with pytest.raises(SchemaError):
            bad()
    for bad in ("col1 AS col2", "col1 AS a, col1 AS b"):
        with pytest.raises(ConfigError):
            O.map_columns(df, bad)


# Joins

LEFT = [(1, "Alice"), (2, "Bob"), (3, "Charlie"), (4, "David")]
RIGHT = [(2, 10.5), (3, 20.0), (5, 30.0)]
JOINED = {
    "inner": [(2, "Bob", 2, 10.5), (3, "Charlie", 3, 20.0)],
    "left": [(1, "Alice", None, None), (2, "Bob", 2, 10.5), (3, "Charlie", 3, 20.0), (4, "David", None, None)],
    "right": [(2, "Bob", 2, 10.5), (3, "Charlie", 3, 20.0), (None, None, 5, 30.0)],
    "full": [(1, "Alice", None, None), (2, "Bob", 2, 10.5), (3, "Charlie", 3, 20.0), (4, "David", None, None), (None, None, 5, 30.0)],
}


@pytest.mark.parametrize("how", sorted(JOINED))
@pytest.mark.parametrize("f", [O.join, O.join_hash, O.join_merge])
def test_join_values_and_names(spark, how, f):
    got = f(spark.createDataFrame(LEFT, "id int, name string"), spark.createDataFrame(RIGHT, "id int, value double"), ["id"], how)
    assert got.columns == ["id", "name", "id_right", "value"]
    same(rows(got), JOINED[how])


def test_join_duplicates_empty_nulls_and_text_null(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, name string")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, v double")
    assert O.join(a, b, ["id"]).count() == 3
    assert O.join(a.limit(0), b.limit(0), ["id"], "full").count() == 0
    n = spark.createDataFrame([(None,), ("NULL",), ("x",)], "k string")
    same(rows(O.join(n, n, ["k"])), [("NULL", "NULL"), ("x", "x")])
    same(rows(O.join(n, n, ["k"], null_safe=True)), [(None, None), ("NULL", "NULL"), ("x", "x")])
    two = O.join(a, a.withColumn("name", F.upper("name")), [("id", "id"), ("name", "name")], "left")
    assert two.columns == ["id", "name", "id_right", "name_right"] and all(r[2] is None for r in rows(two))
    c = spark.createDataFrame([(1, 2, 3)], "id int, id_right int, name int")
    assert O.join(a, c, ["id"]).columns == ["id", "name", "id_right", "id_right_right", "name_right"]
    with pytest.raises(ConfigError):
        O.join(a, b, [])
    with pytest.raises(ConfigError):
        O.join(a, b, ["id"], "sideways")
    with pytest.raises(SchemaError):
        O.join(a, b, [("id", "nope")])


def test_large_joins(spark):
    left = spark.range(150_000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), "id").alias("value"))
    right = spark.range(100_000, 200_000).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("extra"))
    got = O.join_hash(left, right, ["id"])
    assert got.agg(F.count("*"), F.min("id"), F.max("id")).first() == (50_000, 100_000, 149_999)
    assert O.join_hash(left, right.filter("id < 150000"), ["id"], "left").filter("extra IS NULL").count() == 100_000


def test_join_strategies_are_in_the_plan(spark):
    a, b = spark.range(10).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan(O.join_hash(a, b, ["k"])) and "SortMergeJoin" in plan(O.join_merge(a, b, ["k"]))


# Aggregates


def test_aggregate_values(spark):
    data = [("a", 1, 1, 2.5), ("a", 1, None, 1.5), ("a", 2, 5, None), (None, 1, 7, 0.5), (None, 1, 9, None)]
    df = spark.createDataFrame(data, "g string, h int, v int, w double")
    got = O.aggregate(df, ["g"], ["count", "sum:v", "AVG(v)", "min:v", "MAX(w)", "count:v", "MIN(g) AS first"])
    assert got.columns == ["g", "count", "sum_v", "avg_v", "min_v", "max_w", "count_v", "first"]
    same(rows(got), [("a", 3, 6.0, 3.0, 1.0, 2.5, 2, "a"), (None, 2, 16.0, 8.0, 7.0, 0.5, 2, None)])
    same(rows(O.aggregate(df, ["g", "h"], ["COUNT(*)"])), [("a", 1, 2), ("a", 2, 1), (None, 1, 2)])
    assert rows(O.aggregate(df.limit(0), [], ["count", "sum:v"])) == [(0, None)]
    assert rows(O.aggregate(df.limit(0), ["g"], ["count"])) == []
    for bad in ("median:v", "sum", "sum:g", "SUM(v", "sum:v; sum:v"):
        with pytest.raises((ConfigError, SchemaError)):
            O.aggregate(df, ["g"], [bad])
    with pytest.raises(ConfigError):
        O.aggregate(df, ["g"], ["sum:v", "SUM(v)"])


def test_aggregate_of_generated_groups(spark):
    n, g = 1000, 7
    df = spark.range(n).select(F.concat(F.lit("group_"), F.col("id") % g).alias("group_key"), (F.col("id") + 1).alias("amount"))
    got = {r.group_key: tuple(r)[1:] for r in O.aggregate(df, ["group_key"], ["count", "sum:amount", "min:amount", "max:amount"]).collect()}
    for k in range(g):
        own = [i + 1 for i in range(n) if i % g == k]
        assert got[f"group_{k}"] == (len(own), float(sum(own)), float(min(own)), float(max(own)))


# Sort and helpers


def test_sort(spark):
    df = spark.createDataFrame([(50, "a"), (None, "b"), (30, "c"), (None, "d"), (10, "e")], "k long, v string")
    assert [r.k for r in O.sort(df, ["k"]).collect()] == [None, None, 10, 30, 50]
    assert [r.k for r in O.sort(df, ["k DESC"]).collect()] == [50, 30, 10, None, None]
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (float("inf"),), (-0.0,)], "k double")
    assert str([r.k for r in O.sort(nan, ["k"]).collect()]) == "[None, -0.0, 1.0, inf, nan]"
    ties = spark.createDataFrame([(i % 2 + 1, f"m{i:03}") for i in range(200)], "k int, m string").coalesce(1)
    assert [r.m for r in O.sort(ties, ["k"], stable=True).collect()] == [f"m{i:03}" for i in range(0, 200, 2)] + [f"m{i:03}" for i in range(1, 200, 2)]
    long = [("k" * 990 + f"{i:010}",) for i in range(100)]
    random.Random(1).shuffle(long)
    assert rows(O.sort(spark.createDataFrame(long, "k string"), ["k"])) == sorted(long)
    assert rows(O.sort(df.limit(0), ["k"])) == []
    with pytest.raises(ConfigError):
        O.sort(df, [])
    with pytest.raises(SchemaError):
        O.sort(df, ["nope"])


def test_helpers(spark):
    df = spark.range(1000)
    parts = O.hash_partition(df, ["id"], 10)
    assert rows(parts) == rows(O.hash_partition(df, ["id"], 10))
    n = {r.partition: r["count"] for r in parts.groupBy("partition").count().collect()}
    assert set(n) == set(range(10)) and all(60 <= c <= 140 for c in n.values())
    assert O.repartition_by_hash(df, ["id"], 5).rdd.getNumPartitions() == 5
    local = O.sort_by_columns(df.withColumn("k", -F.col("id")).repartition(3, "id"), ["k"])
    assert all(list(p) == sorted(p) for p in local.select("k").rdd.map(lambda r: r.k).glom().collect())
    a = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, value int").coalesce(1)
    b = spark.createDataFrame([(7, 70), (8, 80)], "id long, score int").coalesce(1)
    both = O.concat_columns(a, b)
    assert both.columns == ["id", "value", "id_right", "score"]
    assert rows(both) == [(1, 10, 7, 70), (2, 20, 8, 80), (3, 30, None, None)]
    many = O.number_rows(O.sort(spark.range(5000).repartition(7), ["id"]), "n")
    assert many.filter("id <> n").count() == 0 and many.count() == 5000


# Window


def test_window(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0), ("b", 2, 15.0)], "group string, order long, value double").coalesce(1)
    got = O.window(df, ["group"], ["order"], [WindowFunction("row_number", "rn"), WindowFunction("sum", "total", "value")])
    assert got.columns == ["group", "order", "value", "rn", "total"] and got.dtypes[3:] == [("rn", "bigint"), ("total", "double")]
    same(rows(got), [("a", 1, 10.0, 1, 10.0), ("a", 2, 20.0, 2, 30.0), ("b", 1, 5.0, 1, 5.0), ("b", 2, 15.0, 2, 20.0)])


def test_window_nulls_ties_frames_and_errors(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 1, None), ("a", 1, 4), (None, 5, 8)], "g string, o int, v int").coalesce(1)
    fs = [WindowFunction("row_number", "rn"), WindowFunction("sum", "run", "v"), WindowFunction("sum", "own", "v", "current_row", "current_row")]
    same(rows(O.window(df, ["g"], ["o"], fs)), [("a", None, 1, 1, 1.0, 1.0), ("a", 1, None, 2, 1.0, 0.0), ("a", 1, 4, 3, 5.0, 4.0), (None, 5, 8, 1, 8.0, 8.0)])
    assert [r.rn for r in O.window(df, ["g"], [], fs[:1]).filter("g = 'a'").collect()] == [1, 2, 3]
    for bad in (WindowFunction("rank", "x"), WindowFunction("sum", "x"), WindowFunction("sum", "g", "v"), WindowFunction("sum", "x", "g"), WindowFunction("sum", "x", "v", "following", "current_row"), WindowFunction("sum", "x", "nope")):
        with pytest.raises((ConfigError, SchemaError)):
            O.window(df, ["g"], ["o"], [bad])
    with pytest.raises(SchemaError):
        O.window(df, ["g"], ["nope"], fs)


# Lateral


def test_lateral(spark):
    df = spark.createDataFrame([(1, "a,b,c"), (2, "x,y")], "id long, tags string")
    assert [r.tag for r in O.lateral_explode(df, "tags", "tag").collect()] == ["a", "b", "c", "x", "y"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a.b."), (4, "|"), (5, "p\\Eq\\E")], "id long, t string")
    parts = lambda d: {k: [r.p for r in O.lateral_explode(odd, "t", "p", d).collect() if r.id == k] for k in range(1, 6)}
    assert parts(".") == {1: [""], 2: [""], 3: ["a", "b", ""], 4: ["|"], 5: ["p\\Eq\\E"]}
    assert parts("|")[4] == ["", ""] and parts("\\E")[5] == ["p", "q", ""]
    assert parts("")[2] == ["", ""] and parts("")[4] == ["", "|", ""]
    numbers = spark.createDataFrame([(1, 12.5)], "id long, n double")
    assert [r.p for r in O.lateral_explode(numbers, "n", "p", ".").collect()] == ["12", "5"]
    with pytest.raises(ConfigError):
        O.lateral_explode(df, "tags", "id")
    with pytest.raises(SchemaError):
        O.lateral_explode(df, "nope", "x")


# Statistics


def test_profile_and_stats(spark):
    df = spark.createDataFrame([(1, "x"), (5, None), (None, "y"), (5, "x")], "n int, s string")
    assert rows(profile(df, approximate=False)) == [("n", "1", "5", 1, 2, 4), ("s", "x", "y", 1, 2, 4)]
    got = collect_stats(df)
    assert got["n"] == ColumnStats(1, 5, 1, 2, 4) and got["n"].non_null_count == 3
    assert collect_stats(df.limit(0))["n"] == ColumnStats(None, None, 0, 0, 0)
    with pytest.raises(SchemaError):
        profile(df, ["nope"])


def test_selectivities():
    s = ColumnStats(0, 100, 0, 50, 1000)
    assert s.equality() == 1 / 50 and ColumnStats(0, 1, 0, None, 9).equality() == 0.01 and ColumnStats().equality() == 0.0
    assert s.range(low=75) == 0.25 and s.range(high=25) == 0.25 and s.range(low=200) == 0.0 and s.range(high=-1) == 0.0
    assert s.range(low=-5) == 1.0 and s.range(high=500) == 1.0 and s.range(10, 20) == 0.3 and s.range(200, 300) == 0.0 and s.range() == 1.0
    assert ColumnStats("a", "z", 0, None, 5).range(low="m") == 0.5 and ColumnStats(None, None, 0, None, 5).range(low=1) == 0.5
    both = s.merge(ColumnStats(-5, 50, 3, 9, 10))
    assert both == ColumnStats(-5, 100, 3, None, 1010) and ColumnStats().merge(s).min == 0
