"""The catalogue of registered queries: each applies one operator to a whole table, with the same query in SQL beside it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import operators as O  # noqa: E741
from . import sources
from .functions.stats import collect_stats, profile
from .operators import WindowFunction
from .plans import Pipeline, compile_plan, parse_yaml
from .plans.compiler import replays, run_plan
from .plans.estimate import WorkHint, estimate_work
from .plans.manifest import RunManifest
from .scratch import Workspace
from .streaming import append_stream, stream_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _scan(d: str, table: str) -> Pipeline:
    return Pipeline.scan(f"{d}/{table}.parquet")


def _table(s: SparkSession, d: str, table: str) -> DataFrame:
    return sources.scan(s, f"{d}/{table}.parquet")


# Scan, filter, project, rename


@_query("SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def scan_project(s, d):
    return _scan(d, "lineitem").project("l_orderkey", "l_quantity", "l_shipdate").to_df(s)


@_query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem")
def scan_declared_schema(s, d):
    return Pipeline.scan(f"{d}/lineitem.parquet", [("l_orderkey", "Int64"), ("l_linenumber", "i64")]).to_df(s)


FILTERS = {
    "filter_cmp": ("lineitem", "l_quantity > 45", "l_quantity > 45"),
    "filter_and_or": ("lineitem", "(l_quantity > 45 OR l_discount < 0.01) AND l_returnflag = 'R'", "(l_quantity > 45 OR l_discount < 0.01) AND l_returnflag = 'R'"),
    "filter_precedence": ("lineitem", "l_returnflag = 'N' OR l_quantity > 45 AND l_discount < 0.05", "l_returnflag = 'N' OR (l_quantity > 45 AND l_discount < 0.05)"),
    "filter_arith": ("lineitem", "l_extendedprice * l_quantity > 100000", "l_extendedprice * l_quantity > 100000"),
    "filter_left_assoc": ("lineitem", "l_quantity - 10 - 5 > 20 AND l_quantity / 2 / 2 < 10.5", "l_quantity - 15 > 20 AND l_quantity / 4 < 10.5"),
    "filter_string_eq": ("orders", "o_orderpriority == '1-URGENT'", "o_orderpriority = '1-URGENT'"),
    "filter_eq_ne": ("orders", "o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH'", "o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH'"),
    "filter_not": ("orders", "NOT (o_orderstatus = 'F' OR o_totalprice <= 1000)", "NOT (o_orderstatus = 'F' OR o_totalprice <= 1000)"),
    "filter_decimal_eq": ("lineitem", "l_discount == 0.05", "l_discount = 0.05"),
    "filter_negative": ("customer", "c_acctbal < -500", "c_acctbal < -500"),
}


def _filter(table: str, expr: str) -> Query:
    return lambda s, d: _scan(d, table).filter(expr).to_df(s)


for _name, (_t, _e, _sql) in FILTERS.items():
    _query(f"SELECT * FROM {_t} WHERE {_sql}", _name)(_filter(_t, _e))

_WITH_NULLS = "(SELECT event_id, nullif(event_type, 'view') AS kind, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS u, value FROM events)"


def _with_nulls(s, d):
    e = _table(s, d, "events")
    return e.select("event_id", F.expr("nullif(event_type, 'view')").alias("kind"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("u"), "value")


@_query(f"SELECT * FROM {_WITH_NULLS} WHERE kind IS NULL")
def filter_is_null(s, d):
    return O.filter_rows(_with_nulls(s, d), "kind IS NULL")


@_query(f"SELECT * FROM {_WITH_NULLS} WHERE kind IS NOT NULL AND NOT u > 40")
def filter_is_not_null(s, d):
    return O.filter_rows(_with_nulls(s, d), "kind IS NOT NULL AND NOT u > 40")


@_query(f"SELECT * FROM {_WITH_NULLS} WHERE (u < 20 OR u IS NULL) AND coalesce(kind, '') <> 'click'")
def filter_compat_nulls(s, d):
    return O.filter_rows(_with_nulls(s, d), "u < 20 AND kind != 'click'", compat=True)


@_query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def expr_project(s, d):
    return _scan(d, "lineitem").project("l_orderkey", "l_extendedprice * (1 - l_discount) AS net").to_df(s)


@_query("SELECT p_partkey, CAST(p_size // 7 AS INTEGER) AS sevenths FROM part")
def expr_int_div(s, d):
    return _scan(d, "part").project("p_partkey", "p_size / 7 AS sevenths").to_df(s)


@_query("SELECT p_partkey, p_brand || ': ' || p_name AS label FROM part")
def expr_concat(s, d):
    return _scan(d, "part").project("p_partkey", "p_brand + ': ' + p_name AS label").to_df(s)


@_query("SELECT c_custkey AS id, c_name AS customer, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def map_rename(s, d):
    return _scan(d, "customer").map("c_custkey AS id, c_name AS customer, c_acctbal").to_df(s)


# Aggregates

_AGGS = {"count": "count", "sum": "sum:l_quantity", "min": "min:l_extendedprice", "max": "MAX(l_extendedprice)", "avg": "AVG(l_quantity)"}
_AGG_SQL = {"count": "count(*) AS count", "sum": "sum(l_quantity) AS sum_l_quantity", "min": "min(l_extendedprice) AS min_l_extendedprice", "max": "max(l_extendedprice) AS max_l_extendedprice", "avg": "avg(l_quantity) AS avg_l_quantity"}


def _agg(*aggs: str) -> Query:
    return lambda s, d: _scan(d, "lineitem").aggregate(["l_returnflag"], *aggs).to_df(s)


for _name, _a in _AGGS.items():
    _query(f"SELECT l_returnflag, {_AGG_SQL[_name]} FROM lineitem GROUP BY ALL", f"agg_{_name}")(_agg(_a))
_query(f"SELECT l_returnflag, {', '.join(_AGG_SQL.values())} FROM lineitem GROUP BY ALL", "agg_all")(_agg(*_AGGS.values()))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS count, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY ALL")
def agg_multi_key(s, d):
    return _scan(d, "lineitem").aggregate(["l_returnflag", "l_linestatus"], "COUNT(*)", "SUM(l_quantity)").to_df(s)


@_query("SELECT p_brand, CAST(sum(p_size) AS DOUBLE) AS sum_p_size, CAST(min(p_size) AS DOUBLE) AS min_p_size FROM part GROUP BY ALL")
def agg_int_input(s, d):
    return _scan(d, "part").aggregate(["p_brand"], "sum:p_size", "min:p_size").to_df(s)


@_query(f"SELECT kind, count(*) AS count, count(u) AS count_u, CAST(sum(u) AS DOUBLE) AS sum_u, CAST(max(u) AS DOUBLE) AS max_u FROM {_WITH_NULLS} GROUP BY ALL")
def agg_nulls(s, d):
    return O.aggregate(_with_nulls(s, d), ["kind"], ["count", "count:u", "sum:u", "max:u"])


@_query("SELECT count(*) AS n, min(o_orderpriority) AS min_o_orderpriority, max(o_totalprice) AS top FROM orders")
def agg_global(s, d):
    return _scan(d, "orders").aggregate([], "COUNT(*) AS n", "MIN(o_orderpriority)", "MAX(o_totalprice) AS top").to_df(s)


# Joins of whole tables: keys moved by 100, so that both sides have rows without a partner

_LINES, _ORDERS = "(SELECT l_orderkey + 100 AS okey, l_linenumber, l_quantity FROM lineitem)", "(SELECT o_orderkey AS okey, o_totalprice FROM orders)"


def _join(how: str, strategy: str | None) -> Query:
    lines = lambda s, d: _table(s, d, "lineitem").select((F.col("l_orderkey") + 100).alias("okey"), "l_linenumber", "l_quantity")
    return lambda s, d: O.join(lines(s, d), _table(s, d, "orders").select(F.col("o_orderkey").alias("okey"), "o_totalprice"), ["okey"], how, strategy)


for _how in ("inner", "left", "right", "full"):
    for _strategy, _prefix in ((None, "join"), ("hash", "join_hash"), ("merge", "join_merge")):
        _sql = f"SELECT a.okey, a.l_linenumber, a.l_quantity, b.okey AS okey_right, b.o_totalprice FROM {_LINES} a {_how} JOIN {_ORDERS} b ON a.okey = b.okey"
        _query(_sql, f"{_prefix}_{_how}")(_join(_how, _strategy))


@_query("SELECT a.l_orderkey, a.l_suppkey, a.l_quantity, b.o_orderkey, b.o_custkey FROM lineitem a JOIN orders b ON a.l_orderkey = b.o_orderkey AND a.l_suppkey = b.o_custkey")
def join_multi_key(s, d):
    left = _scan(d, "lineitem").project("l_orderkey", "l_suppkey", "l_quantity")
    return left.join(_scan(d, "orders").project("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey"), ("l_suppkey", "o_custkey")]).to_df(s)


_KINDS = f"(SELECT kind, count(*) AS n FROM {_WITH_NULLS} GROUP BY ALL)"


@_query(f"SELECT a.event_id, a.kind, b.kind AS kind_right, b.n FROM {_WITH_NULLS} a JOIN {_KINDS} b ON a.kind IS NOT DISTINCT FROM b.kind")
def join_null_safe(s, d):
    e = _with_nulls(s, d)
    return O.join(e.select("event_id", "kind"), O.aggregate(e, ["kind"], ["COUNT(*) AS n"]), ["kind"], null_safe=True)


@_query(f"SELECT a.event_id, a.kind, b.kind AS kind_right, b.n FROM {_WITH_NULLS} a LEFT JOIN {_KINDS} b ON a.kind = b.kind")
def join_null_keys(s, d):
    e = _with_nulls(s, d)
    return O.join(e.select("event_id", "kind"), O.aggregate(e, ["kind"], ["COUNT(*) AS n"]), ["kind"], "left")


# Window, sort, lateral


def _window(*functions: WindowFunction) -> Query:
    return lambda s, d: _scan(d, "events").project("event_id", "user_id", "ts", "value").window(["user_id"], ["ts", "event_id"], *functions).project("event_id", *[f.alias for f in functions]).to_df(s)


_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_query(f"SELECT event_id, row_number() {_OVER} AS rn FROM events", "window_row_number")(_window(WindowFunction("row_number", "rn")))
_query("SELECT event_id, value AS own FROM events", "window_frame_current_row")(_window(WindowFunction("sum", "own", "value", "current_row", "current_row")))


@_query(f"SELECT event_id, round(sum(value) {_OVER}, 4) AS running FROM events")
def window_running_sum(s, d):
    return _window(WindowFunction("sum", "running", "value"))(s, d).withColumn("running", F.round("running", 4))


@_query(f"SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn, CAST(sum(coalesce(u, 0)) OVER (PARTITION BY kind ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS us FROM {_WITH_NULLS}")
def window_nulls(s, d):
    kinds = O.window(_with_nulls(s, d), ["kind"], ["event_id"], [WindowFunction("sum", "us", "u")]).select("event_id", "us")
    return O.window(kinds, [], ["event_id"], [WindowFunction("row_number", "rn")]).select("event_id", "rn", "us")


@_query("SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER w AS rn, sum(l_quantity) OVER w AS running FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def window_without_partitions(s, d):
    order = ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice"]
    fs = [WindowFunction("row_number", "rn"), WindowFunction("sum", "running", "l_quantity")]
    return O.window(_table(s, d, "lineitem").select(*order), [], order, fs).select("l_orderkey", "l_linenumber", "l_quantity", "rn", "running")


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderpriority, '3-MEDIUM') NULLS FIRST, o_orderkey) - 1 AS place FROM orders")
def sort_nulls_first(s, d):
    o = _table(s, d, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '3-MEDIUM')").alias("priority"))
    return O.number_rows(O.sort(o, ["priority", "o_orderkey"]), "place").select("o_orderkey", "place")


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def sort_descending(s, d):
    return O.number_rows(O.sort(_table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice DESC", "o_orderkey"]), "place").select("o_orderkey", "place")


@_query("SELECT o_orderkey, o_orderpriority, unnest(string_split(o_orderpriority, '-')) AS part FROM orders")
def lateral_split(s, d):
    return _scan(d, "orders").project("o_orderkey", "o_orderpriority").lateral("o_orderpriority", "part", "-").to_df(s)


@_query("SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS word FROM part")
def lateral_words(s, d):
    return _scan(d, "part").project("p_partkey", "p_name").lateral("p_name", "word", " ").to_df(s)


@_query(f"SELECT event_id, kind, unnest(string_split(coalesce(kind, ''), 'i')) AS part FROM {_WITH_NULLS}")
def lateral_null(s, d):
    return O.lateral_explode(_with_nulls(s, d).select("event_id", "kind"), "kind", "part", "i")


# Helpers and statistics

#: About so many rows make a partition of the local sort.
PART_ROWS = 500_000


@_query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, true AS whole, true AS in_range FROM lineitem")
def hash_partition(s, d):
    """That a key's rows share a partition, and every number is in range."""
    p = O.hash_partition(_table(s, d, "lineitem").select("l_orderkey"), ["l_orderkey"], 10)
    per = p.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("partition").alias("a"), F.max("partition").alias("b"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.every(F.col("a") == F.col("b")).alias("whole"), F.every((F.col("a") >= 0) & (F.col("b") < 10)).alias("in_range"))


@_query(
    "SELECT a.c_custkey, a.c_name, b.c_custkey AS c_custkey_right, b.s_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) a"
    " FULL JOIN (SELECT s_suppkey AS c_custkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) b ON a.r = b.r"
)
def concat_columns(s, d):
    left = O.sort(_table(s, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    right = O.sort(_table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name"), ["c_custkey"])
    return O.concat_columns(left, right)


@_query("SELECT count(*) AS n_rows, 0 AS misplaced, sum(l_quantity) AS quantity FROM lineitem")
def sort_local(s, d):
    """That each partition is in order after the helper has sorted it, and no row is lost.

    A larger table has more partitions, not larger ones, and each is checked by a task of its own.
    """
    lines = _table(s, d, "lineitem").select("l_quantity", "l_orderkey")
    parts = max(4, math.ceil(lines.count() / PART_ROWS))
    dealt = lines.withColumn("to", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).repartitionById(parts, "to").drop("to")  # repartition(parts) would sort each split before
    rows = O.sort_by_columns(dealt, ["l_quantity DESC", "l_orderkey"])
    rows = Workspace(s).keep(rows.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("p", F.shiftright("at", 33).cast("int"))
    after = W.partitionBy("p").orderBy("at")
    wrong = (F.lag("l_quantity").over(after) < F.col("l_quantity")) | ((F.lag("l_quantity").over(after) == F.col("l_quantity")) & (F.lag("l_orderkey").over(after) > F.col("l_orderkey")))
    rows = rows.repartitionById(parts, "p").select("l_quantity", wrong.alias("wrong"))  # by a hash of p, a task would get several
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("wrong").cast("int").alias("misplaced"), F.sum("l_quantity").alias("quantity"))


def _stats_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, count(*) AS total_count FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


@_query(_stats_sql(_WITH_NULLS, ["event_id", "kind", "u"]))
def column_stats(s, d):
    return profile(_with_nulls(s, d), ["event_id", "kind", "u"], approximate=False)


@_query("SELECT count(*) AS source_rows, CAST(round(count(*) * (max(l_quantity) - 30) / (max(l_quantity) - min(l_quantity))) AS BIGINT) AS estimated FROM lineitem")
def work_estimate(s, d):
    path = f"{d}/lineitem.parquet"
    stats = collect_stats(_table(s, d, "lineitem"), ["l_quantity"])
    n = stats["l_quantity"].total_count
    work = estimate_work(Pipeline.scan(path).filter("l_quantity > 30").plan, WorkHint({path: n}, {}, {path: stats}))
    return s.createDataFrame([(work.total_rows, work.output_rows)], "source_rows bigint, estimated bigint")


@_query("SELECT count(*) AS n_rows, sum(o_totalprice) AS price, true AS same, false AS other, true AS kept, false AS rewritten FROM orders WHERE o_totalprice > 5000")
def manifest_replay(s, d):
    """A run with a sink, read back, with what its manifest says of the same plan, of another, and of the output before and after it is written anew."""
    path = Workspace(s).path("orders.parquet")
    plan = lambda least: _scan(d, "orders").filter(f"o_totalprice > {least}").sink(path, "parquet").plan
    manifest, _ = run_plan(s, plan(5000))
    manifest = RunManifest.from_json(manifest.to_json())
    one, two = replays(s, manifest, plan(5000)), replays(s, manifest, plan(6000))
    sources.write_parquet(_table(s, path.rsplit("/", 1)[0], path.rsplit("/", 1)[1].removesuffix(".parquet")), path)
    three = replays(s, manifest, plan(5000))
    out = sources.scan(s, path).agg(F.count("*").alias("n_rows"), F.sum("o_totalprice").alias("price"))
    said = {"same": one["plan"], "other": two["plan"], "kept": one["inputs"] and one["outputs"], "rewritten": three["outputs"]}
    return out.select("*", *[F.lit(v).alias(k) for k, v in said.items()])


# Round trips, YAML, streams

_PART = [("p_partkey", "Int64"), ("p_name", "Utf8"), ("p_size", "Int32"), ("p_retailprice", "Float64")]
_PART_SQL = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


@_query(_PART_SQL)
def csv_roundtrip(s, d):
    path = Workspace(s).path("part.csv")
    sources.write_csv(_table(s, d, "part"), path)
    return sources.read_csv(s, path, _PART)


@_query(_PART_SQL)
def jsonl_roundtrip(s, d):
    path = Workspace(s).path("part.jsonl")
    sources.write_jsonl(_table(s, d, "part"), path)
    return sources.scan(s, path, _PART)


@_query("SELECT doc_id, coalesce(text, '') AS text, lang FROM documents")
def csv_roundtrip_text(s, d):
    """Texts with quotes, commas and line breaks."""
    path = Workspace(s).path("documents.csv")
    sources.write_csv(_table(s, d, "documents").select("lang", "text", "doc_id"), path)
    return sources.read_csv(s, path, [("doc_id", "Int64"), ("text", "Utf8"), ("lang", "Utf8")])


@_query(_PART_SQL)
def csv_headerless(s, d):
    path = Workspace(s).path("part.csv")
    _table(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", "p_brand").write.csv(path, header=False)
    return sources.read_csv(s, path, _PART, header=False)


@_query(
    "SELECT nullif(event_type, 'view') AS a_kind, event_id AS b_id, CASE WHEN user_id % 3 <> 0 THEN user_id END AS c_user, value AS d_value,"
    " '{\"k\":' || event_type || ',\"n\":' || event_id || '}' AS e_both FROM (SELECT * REPLACE ('\"' || event_type || '\"' AS event_type), event_type AS bare FROM events) t".replace("nullif(event_type, 'view')", "nullif(bare, 'view')")
)
def jsonl_inferred(s, d):
    """Without a schema: columns in order of their names, whole numbers as bigint, nested values as text, missing keys null."""
    path = Workspace(s).path("events.jsonl")
    both = F.struct(F.col("event_type").alias("k"), F.col("event_id").alias("n"))
    rows = _table(s, d, "events").select(both.alias("e_both"), F.col("value").alias("d_value"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("c_user"), F.col("event_id").alias("b_id"), F.expr("nullif(event_type, 'view')").alias("a_kind"))
    rows.write.option("ignoreNullFields", True).json(path)
    return sources.scan(s, path)


@_query(_PART_SQL)
def parquet_roundtrip(s, d):
    path = Workspace(s).path("part.parquet")
    sources.write_parquet(_table(s, d, "part"), path, codec="zstd", row_group_bytes=1 << 20)
    return sources.scan(s, path, _PART)


YAML = """
inputs:
  people:
    - {{op: scan, source: "{d}/customer.parquet"}}
    - {{op: project, columns: [c_custkey, c_mktsegment]}}
steps:
  - {{op: scan, source: "{d}/orders.parquet"}}
  - {{op: filter, expr: "o_totalprice > 1000 AND o_orderstatus != 'P'"}}
  - {{op: join, right: people, on: [[o_custkey, c_custkey]], type: inner}}
  - {{op: map, expr: "c_mktsegment AS segment"}}
  - {{op: aggregate, group_by: [segment], aggs: ["COUNT(*) AS orders", "MAX(o_totalprice)"]}}
  - {{op: sort, by: [segment]}}
"""


@_query("SELECT c_mktsegment AS segment, count(*) AS orders, max(o_totalprice) AS max_o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' GROUP BY ALL")
def yaml_pipeline(s, d):
    return compile_plan(s, parse_yaml(YAML.format(d=d)).plan)


@_query("SELECT event_id, user_id, value * 2 AS twice, unnest(string_split(event_type, 'c')) AS part FROM events WHERE value > 1")
def stream_pipeline(s, d):
    source = Workspace(s)
    path = source.path("events.parquet")  # a stream reads a folder
    sources.write_parquet(_table(s, d, "events").select("event_id", "user_id", "event_type", "value"), path)
    fields = [("event_id", "Int64"), ("user_id", "Int64"), ("event_type", "Utf8"), ("value", "Float64")]
    plan = Pipeline.scan(path, fields).filter("value > 1").project("event_id", "user_id", "event_type", "value * 2 AS twice").lateral("event_type", "part", "c").project("event_id", "user_id", "twice", "part").plan
    out = source.path("out")
    append_stream(stream_frame(s, plan), out, source.path("state")).awaitTermination()
    return sources.read_parquet(s, out)
