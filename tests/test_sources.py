import json
import math

import pytest
from pipespark import sources
from pipespark.errors import ConfigError, SchemaError, SourceError
from py4j.protocol import Py4JJavaError

FIELDS = [("id", "Int64"), ("name", "Utf8"), ("score", "Float64"), ("ok", "Bool"), ("n", "i32")]


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_is_bound_by_name_and_strict(spark, tmp_path):
    path = put(tmp_path, "a.csv", " ok ,extra, id,name,score,n\ntrue,x,1,Ann,1.5,7\nTRUE,x, 5,,NaN,99999999999\nfalse,x,abc,\" b \", 2,\n,x,+3,z,1e3,-4\nt,x,4\n")
    got = rows(sources.read_csv(spark, path, FIELDS))
    assert got[0] == (1, "Ann", 1.5, True, 7)
    assert got[1][:2] == (None, "") and math.isnan(got[1][2]) and got[1][3:] == (None, None)
    assert got[2] == (None, " b ", None, False, None)
    assert got[3] == (3, "z", 1000.0, None, -4)
    assert got[4] == (4, "", None, None, None)
    assert sources.read_csv(spark, path).columns == ["ok", "extra", "id", "name", "score", "n"]
    with pytest.raises(SchemaError) as e:
        sources.read_csv(spark, path, [("nope", "Int64")])
    assert "available columns" in str(e.value)
    with pytest.raises(ConfigError):
        sources.read_csv(spark, path, [("id", "Int65")])


def test_csv_without_header_and_empty(spark, tmp_path):
    path = put(tmp_path, "b.csv", "1,x,2.5\n2\n3,,\n")
    fields = [("a", "Int32"), ("b", "Utf8"), ("c", "Float32"), ("d", "Utf8")]
    assert rows(sources.read_csv(spark, path, fields, header=False)) == [(1, "x", 2.5, None), (2, None, None, None), (3, None, None, None)]
    with pytest.raises(SchemaError):
        sources.read_csv(spark, path, header=False)
    empty = put(tmp_path, "c.csv", "a,b\n")
    assert sources.read_csv(spark, empty, [("a", "Int32")]).count() == 0
    with pytest.raises(SourceError, match="no data in CSV file"):
        sources.read_csv(spark, empty, need_rows=True)


def test_csv_of_many_rows_is_whole(spark, tmp_path):
    path = put(tmp_path, "d.csv", "id\n" + "\n".join(map(str, range(25_000))) + "\n")
    assert sources.read_csv(spark, path, [("id", "Int64")]).agg({"id": "sum"}).first()[0] == sum(range(25_000))


def test_jsonl(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"b": 1, "a": "x"}\n\n{"a": null, "c": [1, 2], "d": {"k": true}}\n{"b": 2.5}\n')
    df = sources.read_jsonl(spark, path)
    assert df.columns == ["a", "b", "c", "d"] and dict(df.dtypes)["b"] == "double"
    assert rows(df) == [("x", 1.0, None, None), (None, None, "[1,2]", '{"k":true}'), (None, 2.5, None, None)]
    assert rows(sources.scan(spark, path, [("b", "Float64"), ("a", "Utf8")]))[0] == (1.0, "x")
    with pytest.raises(Py4JJavaError):
        sources.read_jsonl(spark, put(tmp_path, "bad.jsonl", '{"a": 1}\n{"a": \n'), [("a", "Int64")]).collect()


PARQUET = [(1, "Al", 95.5, True), (2, None, 87.0, False), (3, "", 92.25, True), (4, "D", None, True), (5, "E", 88.1, None)]


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "zstd", "lz4"])
def test_parquet_codecs_and_projection(spark, tmp_path, codec):
    df = spark.createDataFrame(PARQUET, "id int, name string, score double, active boolean")
    path = f"file://{tmp_path}/p-{codec}.parquet"
    sources.write_parquet(df, path, codec=codec, row_group_bytes=1 << 20)
    assert sorted(rows(sources.read_parquet(spark, path))) == PARQUET
    got = sources.scan(spark, path, [("score", "Float64"), ("id", "Int64")])
    assert got.dtypes == [("score", "double"), ("id", "bigint")]
    with pytest.raises(SchemaError):
        sources.read_parquet(spark, path, ["nope"])
    with pytest.raises(ConfigError):
        sources.write_parquet(df, path, codec="brotli9")


def test_filters_and_columns_reach_the_files(spark):
    from pipespark.plans import Pipeline

    df = Pipeline.scan("/root/testdata/sf0.001/lineitem.parquet").filter("l_quantity > 45").project("l_orderkey").to_df(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1.0, bytearray(b"abc"), 'q"uo,te'), (2, "", 2.5, None, " pad ")], "id int, t string, v double, b binary, s string")
    path = tmp_path / "out.csv"
    sources.write_csv(df, f"file://{path}", single=True)
    assert path.read_text().splitlines() == ["id,t,v,b,s", '1,,1.0,[binary 3 bytes],"q""uo,te"', "2,,2.5,, pad "]
    sources.sink(df.limit(0), f"file://{path}", "csv", single=True)
    assert path.read_text().strip() in ("", "id,t,v,b,s")
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".out")] in ([], [".out.csv.crc"])
    with pytest.raises(SourceError):
        sources.write_csv(df, f"file://{path}", mode="error")


def test_jsonl_sink_keeps_nulls_and_sorts_keys(spark, tmp_path):
    df = spark.createDataFrame([(2, None, bytearray(b"hi"))], "z int, a string, m binary")
    path = tmp_path / "o.jsonl"
    sources.sink(df, f"file://{path}", "jsonl", single=True)
    assert path.read_text().strip() == '{"a":null,"m":"hi","z":2}'
    assert json.loads(path.read_text()) == {"a": None, "m": "hi", "z": 2}


def test_a_sink_may_replace_what_it_reads(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    sources.write_parquet(spark.range(10).toDF("id"), path)
    sources.write_parquet(sources.read_parquet(spark, path).filter("id > 6"), path)
    assert spark.read.parquet(path).count() == 3
    sources.write_parquet(spark.range(2).toDF("id"), path, mode="append")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ConfigError):
        sources.sink(spark.range(1), path, "orc")


def test_detection(spark, capsys):
    names = {"a.parquet": "parquet", "a.PARQ": "parquet", "b.jsonl": "jsonl", "b.ndjson": "jsonl", "c.csv": "csv", "d": "csv", "s3://b/x.parquet/": "parquet"}
    assert {k: sources.detect_format(k) for k in names} == names
    sources.sink(spark.range(1), "stdout")


def test_storage(spark, tmp_path):
    store, path = sources.Storage(spark), f"file://{tmp_path}/deep/er/x.bin"
    store.write(path, bytes(range(200)))
    assert store.exists(path) and store.size(path) == 200
    assert store.read_range(path, 10, 5) == bytes(range(10, 15)) and store.read_range(path, 190, 99) == bytes(range(190, 200)) and store.read_range(path, 500, 1) == b""
    assert [p.rsplit("/", 1)[1] for p in store.list(f"file://{tmp_path}/deep/er")] == ["x.bin"] and store.list(f"file://{tmp_path}/none") == []
    tag = store.etag(path)
    assert tag == store.etag(path)
    store.write(path, b"other")
    assert store.etag(path) != tag and store.read_range(path, 0, 9) == b"other"
    assert store.delete(path) and not store.delete(path)
    for bad in (lambda: store.size(path), lambda: store.exists("nosuch://x/y")):
        with pytest.raises(SourceError):
            bad()


def test_csv_cells_may_hold_line_breaks(spark, tmp_path):
    rows_ = [(1, 'two\nlines, "quoted"'), (2, "cr\r\nlf\n\n"), (3, ""), (4, "plain"), (5, '"'), (6, "\n")]
    path = f"file://{tmp_path}/breaks.csv"
    sources.write_csv(spark.createDataFrame(rows_, "id long, t string"), path)
    assert sorted(rows(sources.read_csv(spark, path, [("id", "Int64"), ("t", "Utf8")]))) == rows_
    flat = put(tmp_path, "flat.csv", "id,t\n1,a\n2,b\n")
    assert sources.read_csv(spark, flat, [("id", "Int64")], multi_line=False).count() == 2
