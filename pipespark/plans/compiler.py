"""Plans to DataFrames.  Compilation is lazy: only a sink runs a job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import operators as O  # noqa: E741
from ..errors import ConfigError, PipelineError
from ..sources import Storage, scan, sink
from . import nodes as N
from .manifest import RunManifest, inputs_digest, same_plan, started

Apply = Callable[[SparkSession, DataFrame, object, bool], DataFrame]

STEPS: dict[type, Apply] = {
    N.Filter: lambda s, df, x, compat: O.filter_rows(df, x.expr, compat),
    N.Project: lambda s, df, x, compat: O.project(df, x.columns, compat),
    N.Map: lambda s, df, x, compat: O.map_columns(df, x.expr),
    N.Aggregate: lambda s, df, x, compat: O.aggregate(df, x.group_by, x.aggs),
    N.Join: lambda s, df, x, compat: O.join(df, compile_plan(s, x.right, compat), x.on, x.type, x.strategy, x.null_safe),
    N.WindowStep: lambda s, df, x, compat: O.window(df, x.partitions, x.order_by, x.functions),
    N.Lateral: lambda s, df, x, compat: O.lateral_explode(df, x.column, x.alias, x.delimiter),
    N.Sort: lambda s, df, x, compat: O.sort(df, x.by, x.stable),
}


def register_step(node: type, apply: Apply) -> None:
    """Adds a kind of step: ``apply(spark, df, step, compat)`` gives the new frame."""
    if node in STEPS:
        raise ConfigError(f"step {node.__name__} is already registered")
    STEPS[node] = apply


def check(plan: N.Plan) -> None:
    if not plan.steps:
        raise ConfigError("the pipeline has no steps")
    if not isinstance(plan.steps[0], N.Scan):
        raise ConfigError("the first step must be a scan")
    for i, step in enumerate(plan.steps[1:], 2):
        if isinstance(step, N.Scan):
            raise ConfigError(f"step {i}: only the first step can be a scan", hints=["a join's right side has its own"])
        if isinstance(step, N.Sink) and i < len(plan.steps):
            raise ConfigError(f"step {i}: a sink must be the last step")
        if isinstance(step, N.Join):
            check(step.right)
            if isinstance(step.right.steps[-1], N.Sink):
                raise ConfigError(f"step {i}: the right side of a join can't end in a sink")


def compile_plan(spark: SparkSession, plan: N.Plan, compat: bool = False, start: DataFrame | None = None) -> DataFrame:
    """The frame of all steps but a closing sink; ``start`` takes the place of the scan's own read."""
    check(plan)
    first = plan.steps[0]
    try:
        df = start if start is not None else scan(spark, first.source, [(f.name, f.type, f.nullable) for f in first.schema], first.format)
    except PipelineError as e:
        raise e.within("step 1 (Scan)")
    for i, step in enumerate(plan.steps[1:], 2):
        if isinstance(step, N.Sink):
            break
        try:
            df = STEPS[type(step)](spark, df, step, compat)
        except PipelineError as e:
            raise e.within(f"step {i} ({type(step).__name__})")
    return df


def run_plan(spark: SparkSession, plan: N.Plan, compat: bool = False) -> tuple[RunManifest, DataFrame]:
    """Runs the plan's sink, if it has one, and returns a manifest with the lazy frame."""
    begun = started(plan)
    df = compile_plan(spark, plan, compat)
    inputs = inputs_digest(spark, sorted(sources_of(plan)))  # before a sink may replace them
    last, written = plan.steps[-1], None
    if isinstance(last, N.Sink):
        options = {"single": last.single} | ({"codec": last.codec} if last.codec else {})
        try:
            sink(df, last.destination, last.format, **({} if last.destination == "stdout" else options))
        except PipelineError as e:
            raise e.within(f"step {len(plan.steps)} (Sink)")
        if last.destination != "stdout":
            written = inputs_digest(spark, [last.destination])
    return begun.finished(df, inputs, written), df


def replays(spark: SparkSession, manifest: RunManifest, plan: N.Plan) -> dict[str, bool]:
    """Whether a recorded run was of this plan, and whether its inputs and its output are as it left them."""
    last = plan.steps[-1]
    out = {"plan": same_plan(manifest, plan), "inputs": manifest.inputs_digest == inputs_digest(spark, sorted(sources_of(plan)))}
    if isinstance(last, N.Sink) and last.destination != "stdout":
        out["outputs"] = Storage(spark).exists(last.destination) and manifest.outputs_digest == inputs_digest(spark, [last.destination])
    return out


def sources_of(plan: N.Plan) -> set[str]:
    own = {s.source for s in plan.steps if isinstance(s, N.Scan)}
    return own.union(*(sources_of(s.right) for s in plan.steps if isinstance(s, N.Join)))
