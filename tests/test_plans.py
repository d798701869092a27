import dataclasses
import json

import pytest
from pipespark.errors import ConfigError, PipelineError, SchemaError, SourceError
from pipespark.functions import expr as E
from pipespark.functions.stats import ColumnStats
from pipespark.operators import WindowFunction, window
from pipespark.plans import Pipeline, compile_plan, parse_yaml, run_plan
from pipespark.plans import nodes as N
from pipespark.plans.cli import main
from pipespark.plans.compiler import STEPS, register_step, replays
from pipespark.plans.config import EngineConfig
from pipespark.plans.estimate import WorkHint, estimate_work, group_rows, join_rows, selectivity
from pipespark.plans.manifest import RunManifest, content_digest, inputs_digest, plan_hash, same_plan
from pipespark.streaming import append_stream, stream_frame
from pyspark.sql import functions as F

PEOPLE = "id,name,age,email\n" + "".join(f"{i},Person{i},{20 + i % 50},person{i}@test.com\n" for i in range(1000))
SCHEMA = "[{name: id, type: Int64}, {name: name, type: Utf8}, {name: age, type: Int64}, {name: email, type: Utf8}]"


@pytest.fixture()
def people(tmp_path):
    (tmp_path / "people.csv").write_text(PEOPLE)
    return f"file://{tmp_path}/people.csv"


def steps(people, *more):
    return "steps:\n" + "".join(f"  - {s}\n" for s in (f'{{op: scan, source: "{people}", schema: {SCHEMA}}}', *more))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_filter_project_sink(spark, people, tmp_path):
    text = steps(people, '{op: filter, expr: "age > 25"}', "{op: project, columns: [name, email]}", f'{{op: sink, destination: "file://{tmp_path}/o.csv", format: csv, single: true}}')
    manifest, df = run_plan(spark, parse_yaml(text).plan)
    assert df.columns == ["name", "email"] and df.count() == 880
    assert len((tmp_path / "o.csv").read_text().splitlines()) == 881
    assert manifest.finished_ms >= manifest.started_ms and same_plan(manifest, parse_yaml(text).plan)
    assert json.loads(manifest.to_json())["plan_hash"] == manifest.plan_hash


def test_every_step_in_yaml(spark, people):
    text = f"""
config: {{max_parallel_tasks: 2}}
inputs:
  limits: [{{op: scan, source: "{people}", schema: {SCHEMA}}}, {{op: filter, expr: "id < 500"}}, {{op: project, columns: [id, age]}}]
""" + steps(
        people,
        "{op: map, expr: 'name AS who, email'}",
        "{op: join, right: limits, on: [id], type: left}",
        "{op: filter, expr: 'id_right IS NULL'}",
        "{op: lateral, column: email, alias: part, delimiter: '@'}",
        "{op: window, partitions: [age], order_by: [id, part], functions: [{alias: rn, type: row_number}, {alias: s, type: sum, column: id, frame: {start: current_row, end: current_row}}]}",
        "{op: aggregate, group_by: [age], aggs: ['COUNT(*)', 'MAX(rn)', 'SUM(s)']}",
        "{op: sort, by: [age DESC]}",
    )
    parsed = parse_yaml(text)
    assert parsed.config == {"max_parallel_tasks": 2}
    got = [tuple(r) for r in compile_plan(spark, parsed.plan).collect()]
    assert [r[0] for r in got] == list(range(69, 19, -1))
    assert all(r[1:3] == (20, 20.0) and r[3] == 2.0 * sum(i for i in range(500, 1000) if 20 + i % 50 == r[0]) for r in got)


def test_yaml_equals_builder(spark, people):
    fields = [("id", "Int64"), ("name", "Utf8"), ("age", "Int64"), ("email", "Utf8")]
    built = Pipeline.scan(people, fields).filter("age > 60").window(["age"], ["id"], WindowFunction("row_number", "rn")).sort("id")
    text = steps(people, '{op: filter, expr: "age > 60"}', "{op: window, partitions: [age], order_by: [id], functions: [{alias: rn, type: row_number}]}", "{op: sort, by: [id]}")
    assert parse_yaml(text).plan == built.plan and plan_hash(parse_yaml(text).plan) == plan_hash(built.plan)
    assert plan_hash(built.filter("id > 1").plan) != plan_hash(built.plan)


@pytest.mark.parametrize(
    "text,says",
    [
        ("steps: []", "no steps"),
        ("nothing: 1", "needs 'steps'"),
        ("steps: [{expr: x}]", "missing field 'op'"),
        ("steps: [{op: filtre}]", "did you mean 'filter'"),
        ("steps: [{op: filter, expr: 'a > 1'}]", "first step must be a scan"),
        ("steps: [{op: scan, source: a.csv}, {op: scan, source: b.csv}]", "only the first step"),
        ("steps: [{op: scan, source: a.csv}, {op: sink, destination: x}, {op: filter}]", "sink must be the last"),
        ("steps: [{op: scan, source: a.csv, schema: [{name: x, type: Int6}]}]", "unknown type 'Int6'"),
        ("steps: [{op: scan, source: a.csv}, {op: window, functions: [{alias: r, type: rank}]}]", "unknown window function"),
        ("steps: [{op: scan, source: a.csv}, {op: window, functions: [{alias: r, type: sum}]}]", "needs a column"),
        ("steps: [{op: scan, source: a.csv}, {op: join, right: b, on: [x]}]", "unknown input 'b'"),
        ("steps: [{op: scan, source: a.csv}, {op: project}]", "missing field 'columns'"),
        ("steps: [{op: scan, source: a.csv}, {op: filter, exp: x}]", "unknown field"),
        ("steps: [scan]", "must be a mapping"),
        ("steps: [", "not valid YAML"),
        ("stages: 1\nsteps: [{op: scan, source: a}]", "unknown section"),
    ],
)
def test_bad_yaml(text, says):
    with pytest.raises(ConfigError) as e:
        parse_yaml(text)
    assert says in str(e.value)


def test_errors_say_where(spark, people):
    with pytest.raises(SchemaError) as e:
        compile_plan(spark, parse_yaml(steps(people, '{op: filter, expr: "agee > 1"}')).plan)
    assert str(e.value).startswith("step 2 (Filter): column 'agee' not found") and "did you mean 'age'?" in e.value.suggestions()
    assert isinstance(e.value, PipelineError)


def test_compat_mode_reaches_filters(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    plan = Pipeline.scan("unused").filter("x < 5").plan
    assert compile_plan(spark, plan, compat=False, start=df).count() == 1 and compile_plan(spark, plan, compat=True, start=df).count() == 2


def test_own_steps_can_be_registered(spark):
    @dataclasses.dataclass(frozen=True)
    class Double:
        column: str

    register_step(Double, lambda s, df, step, compat: df.withColumn(step.column, F.col(step.column) * 2))
    try:
        plan = N.Plan((N.Scan("unused"), Double("x")))
        assert rows(compile_plan(spark, plan, start=spark.createDataFrame([(2,)], "x int"))) == [(4,)]
        with pytest.raises(ConfigError):
            register_step(Double, None)
    finally:
        STEPS.pop(Double)


def test_layers_of_settings():
    env = {"PIPESPARK_SEED": "7", "PIPESPARK_MEM_CAP_BYTES": "1000000000", "PIPESPARK_MAX_PARALLEL_TASKS": "3", "OTHER": "x"}
    c = EngineConfig.layered({"max_parallel_tasks": 5, "spill_dir": "/tmp/s"}, {"mem_cap_bytes": 2 << 30, "spill_dir": None}, env)
    assert (c.seed, c.mem_cap_bytes, c.max_parallel_tasks, c.spill_dir) == (7, 2 << 30, 5, "/tmp/s")
    conf = c.spark_conf()
    assert conf["spark.driver.memory"] == "2048m" and conf["spark.local.dir"] == "/tmp/s" and conf["spark.task.maxFailures"] == "4"
    assert EngineConfig.layered({"block_size_hint": 1 << 24}, env={}).spark_conf()["spark.sql.files.maxPartitionBytes"] == str(1 << 24)
    with pytest.warns(UserWarning, match="unknown setting"):
        EngineConfig.layered({"spill_retries": 1}, env={})
    with pytest.raises(ConfigError):
        EngineConfig.layered({"seed": "x"}, env={})
    with pytest.raises(ConfigError, match="unsupported spill scheme"):
        EngineConfig.layered({"spill_uri": "ftp://x"}, env={})
    secret = EngineConfig.layered({"spill_aws_secret_access_key": "k"}, env={}).spark_conf()
    assert secret["spark.hadoop.fs.s3a.secret.key"] == "k"


def test_estimates():
    stats = {"age": ColumnStats(18, 65, 0, 48, 1000), "status": ColumnStats("a", "c", 100, 3, 1000)}
    sel = lambda t: selectivity(E.parse(t), stats)
    assert sel("age > 30") == pytest.approx(35 / 47) and sel("30 < age") == sel("age > 30")
    assert sel("status = 'a'") == pytest.approx(1 / 3) and sel("status != 'a'") == pytest.approx(2 / 3)
    assert sel("age > 30 AND status = 'a'") == pytest.approx(35 / 141) and sel("NOT age > 30") == pytest.approx(12 / 47)
    assert sel("status IS NULL") == 0.1 and sel("status IS NOT NULL") == 0.9 and sel("other = 1") == 0.01 and sel("other > 1") == 0.5
    assert join_rows(100, 200, 50, 10) == 400 and join_rows(100, 200, None, None) == 100
    assert group_rows(1000, [3, 4]) == 12 and group_rows(10, [30]) == 10 and group_rows(1000, [None]) == 100 and group_rows(3, [None]) == 1
    hint = WorkHint({"a": 1000, "b": 50}, {"a": 64_000}, {"a": stats, "b": {"age": ColumnStats(18, 65, 0, 50, 50)}})
    plan = Pipeline.scan("a", [("age", "Int64")]).filter("age > 30").join(Pipeline.scan("b", [("age", "Int64")]), ["age"]).aggregate(["status"], "count").plan
    work = estimate_work(plan, hint)
    assert (work.total_rows, work.total_bytes, work.max_fan_in, work.output_rows) == (1050, 64_400, 2, 3)
    assert estimate_work(Pipeline.scan("z").plan).total_rows == 0


def test_content_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    assert content_digest(a) == content_digest(a.orderBy("k", ascending=False).repartition(3)) != content_digest(a.distinct())


def test_command_line(spark, people, tmp_path, capsys):
    good, bad = tmp_path / "p.yaml", tmp_path / "b.yaml"
    good.write_text(steps(people, '{op: filter, expr: "age > 60"}', f'{{op: sink, destination: "file://{tmp_path}/out.jsonl", format: jsonl, single: true}}'))
    bad.write_text("steps: [{op: nope}]")
    assert main(["validate", "-p", str(good)]) == 0 and "3 steps" in capsys.readouterr().out
    assert main(["validate", "-p", str(bad)]) == 1 and "unknown step" in capsys.readouterr().err
    assert main(["run", "-p", str(good), "--manifest", str(tmp_path / "m.json"), "--max-parallel", "2"]) == 0
    assert len((tmp_path / "out.jsonl").read_text().splitlines()) == 180
    assert json.loads((tmp_path / "m.json").read_text())["engine_version"]
    assert main(["explain", "-p", str(good)]) == 0 and "Physical Plan" in capsys.readouterr().out
    assert main(["run", "-p", str(tmp_path / "none.yaml")]) == 1


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(100).select("id", F.concat(F.lit("a,b"), "id").alias("t")).repartition(4).write.parquet(f"file://{src}")
    table = tmp_path / "right.csv"
    table.write_text("k,w\n1,one\n2,two\n")
    right = Pipeline.scan(f"file://{table}", [("k", "Int64"), ("w", "Utf8")])
    flow = Pipeline.scan(f"file://{src}", [("id", "Int64"), ("t", "Utf8")], "parquet").filter("id < 10").lateral("t", "part").join(right, [("id", "k")], "left")
    out, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    append_stream(stream_frame(spark, flow.plan, files_per_batch=1), out, state).awaitTermination()
    batch = compile_plan(spark, flow.plan)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert key(spark.read.parquet(out)) == key(batch) and batch.count() == 20
    append_stream(stream_frame(spark, flow.plan), out, state).awaitTermination()  # nothing is done twice
    assert spark.read.parquet(out).count() == 20
    for bad in (flow.sort("id"), flow.aggregate(["id"], "count"), Pipeline.scan(f"file://{src}")):
        with pytest.raises(ConfigError):
            stream_frame(spark, bad.plan)


def test_manifests_of_patterns_and_folders(spark, tmp_path):
    """Inputs are digested before the sink runs, by the files that a pattern or a folder stands for."""
    for i in range(3):
        (tmp_path / f"in{i}.csv").write_text(f"id\n{i}\n")
    out = f"file://{tmp_path}/out.parquet"
    plan = Pipeline.scan(f"file://{tmp_path}/*.csv", [("id", "Int64")]).filter("id > 0").sink(out, "parquet").plan
    manifest, df = run_plan(spark, plan)
    assert spark.read.parquet(out).count() == 2 and manifest.inputs_digest and manifest.outputs_digest
    again = RunManifest.from_json(manifest.to_json())
    assert replays(spark, again, plan) == {"plan": True, "inputs": True, "outputs": True}
    (tmp_path / "in3.csv").write_text("id\n3\n")
    assert replays(spark, again, plan) == {"plan": True, "inputs": False, "outputs": True}
    before = inputs_digest(spark, [out])
    spark.range(1).write.mode("append").parquet(out)
    assert inputs_digest(spark, [out]) != before and not replays(spark, again, plan)["outputs"]
    with pytest.raises(SourceError):
        inputs_digest(spark, [f"file://{tmp_path}/none*.csv"])


def test_windows_without_partitions(spark):
    fs = [WindowFunction("row_number", "rn"), WindowFunction("sum", "total", "v"), WindowFunction("sum", "own", "v", "current_row", "current_row")]
    df = spark.range(1000).selectExpr("id", "id % 7 AS k", "if(id % 5 = 0, null, id) AS v").repartition(6)
    want, total = {}, 0.0
    got = window(df, [], ["k", "id"], fs)
    for n, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, r.id)), 1):
        total += r.v or 0
        want[r.id] = (n, total, float(r.v or 0))
    assert {r.id: (r.rn, r.total, r.own) for r in got.collect()} == want and got.columns == ["id", "k", "v", "rn", "total", "own"]
    plain = window(spark.range(20).coalesce(1), [], [], [WindowFunction("row_number", "rn")])
    assert {r.id: r.rn for r in plain.collect()} == {i: i + 1 for i in range(20)}
    assert window(df.limit(0), [], ["id"], fs).count() == 0
