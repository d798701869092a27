"""Pipelines: steps, the YAML and fluent front ends, the compiler to DataFrames, estimates, manifests and settings."""

from .builder import Pipeline
from .compiler import compile_plan, run_plan
from .yaml_dsl import parse_yaml

__all__ = ["Pipeline", "compile_plan", "parse_yaml", "run_plan"]
