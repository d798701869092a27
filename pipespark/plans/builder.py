"""The fluent front end: the same steps as YAML, written in Python."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.window import WindowFunction
from . import nodes as N
from .compiler import compile_plan, run_plan


@dataclasses.dataclass(frozen=True)
class Pipeline:
    plan: N.Plan = N.Plan(())

    def _with(self, step: N.Step) -> Pipeline:
        return Pipeline(N.Plan((*self.plan.steps, step)))

    @classmethod
    def scan(cls, source: str, schema: Sequence[tuple] = (), format: str | None = None) -> Pipeline:
        return cls(N.Plan((N.Scan(source, tuple(N.Field(*f) for f in schema), format),)))

    def filter(self, expr: str) -> Pipeline:
        return self._with(N.Filter(expr))

    def project(self, *columns: str) -> Pipeline:
        return self._with(N.Project(columns))

    def map(self, expr: str) -> Pipeline:
        return self._with(N.Map(expr))

    def aggregate(self, group_by: Sequence[str], *aggs: str) -> Pipeline:
        return self._with(N.Aggregate(tuple(group_by), aggs))

    def join(self, right: Pipeline, on: Sequence[tuple[str, str] | str], type: str = "inner", strategy: str | None = None, null_safe: bool = False) -> Pipeline:
        pairs = tuple((k, k) if isinstance(k, str) else tuple(k) for k in on)
        return self._with(N.Join(right.plan, pairs, type, strategy, null_safe))

    def window(self, partitions: Sequence[str], order_by: Sequence[str], *functions: WindowFunction) -> Pipeline:
        return self._with(N.WindowStep(tuple(partitions), tuple(order_by), functions))

    def lateral(self, column: str, alias: str, delimiter: str = ",") -> Pipeline:
        return self._with(N.Lateral(column, alias, delimiter))

    def sort(self, *by: str, stable: bool = False) -> Pipeline:
        return self._with(N.Sort(by, stable))

    def sink(self, destination: str, format: str = "csv", single: bool = False, codec: str | None = None) -> Pipeline:
        return self._with(N.Sink(destination, format, single, codec))

    def to_df(self, spark: SparkSession, compat: bool = False) -> DataFrame:
        return compile_plan(spark, self.plan, compat)

    def run(self, spark: SparkSession, compat: bool = False):
        return run_plan(spark, self.plan, compat)
