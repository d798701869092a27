"""The same steps on a stream of files.

Row-wise steps (filter, project, map, lateral, and joins with a table as the right side) run on the stream as they do
on a table.  Steps that need all rows (aggregate, window, sort) have no batch meaning on an endless input and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..errors import ConfigError
from ..plans import nodes as N
from ..plans.compiler import check, compile_plan
from ..sources.scan import detect_format, struct_of

ROW_WISE = (N.Filter, N.Project, N.Map, N.Lateral, N.Join, N.Sink)


def stream_frame(spark: SparkSession, plan: N.Plan, files_per_batch: int | None = None, compat: bool = False) -> DataFrame:
    """The plan's streaming frame; the scan's source is a folder and its schema is required."""
    check(plan)
    first = plan.steps[0]
    for i, step in enumerate(plan.steps[1:], 2):
        if not isinstance(step, ROW_WISE):
            raise ConfigError(f"step {i} ({type(step).__name__}) needs all rows and can't run on a stream")
        if isinstance(step, N.Join) and step.type not in ("inner", "left"):
            raise ConfigError(f"step {i}: a stream joins a table by inner or left join only")
    if not first.schema:
        raise ConfigError("a stream's scan needs a schema")
    kind = first.format or detect_format(first.source)
    reader = spark.readStream.schema(struct_of([(f.name, f.type, f.nullable) for f in first.schema]))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if kind == "csv":
        reader = reader.option("header", True)
    return compile_plan(spark, plan, compat, start=reader.format("json" if kind == "jsonl" else kind).load(first.source))


def append_stream(df: DataFrame, destination: str, checkpoint: str, format: str = "parquet", once: bool = True) -> StreamingQuery:
    """Appends batches to a folder, each exactly once; with ``once`` it stops when all files there are done."""
    writer = df.writeStream.outputMode("append").format("json" if format == "jsonl" else format).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(destination)
