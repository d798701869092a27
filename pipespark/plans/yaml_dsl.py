"""Pipelines in YAML.

    config: {mem_cap_bytes: 1073741824}
    inputs:                       # named right sides of joins, each a list of steps
      owners: [{op: scan, source: owners.csv, schema: [{name: id, type: Int64}]}]
    steps:
      - {op: scan, source: in.csv, schema: [{name: id, type: Int64}]}
      - {op: filter, expr: "id > 5"}
      - {op: join, right: owners, on: [[id, id]], type: left}
      - {op: sink, destination: out.csv, format: csv}
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from typing import Any

from ..errors import ConfigError, PipelineError, unknown
from ..functions.types import parse_type
from ..operators.window import KINDS, WindowFunction
from . import nodes as N
from .compiler import check


@dataclasses.dataclass(frozen=True)
class ParsedPipeline:
    plan: N.Plan
    config: dict[str, Any]


#: Fields of each step: those it needs, and those it may have.
FIELDS: dict[str, tuple[set[str], set[str]]] = {
    "scan": ({"source"}, {"schema", "format"}),
    "filter": (set(), {"expr"}),
    "project": ({"columns"}, set()),
    "map": ({"expr"}, set()),
    "aggregate": ({"aggs"}, {"group_by"}),
    "join": ({"right", "on"}, {"type", "strategy", "null_safe"}),
    "window": ({"functions"}, {"partitions", "order_by"}),
    "lateral": ({"column", "alias"}, {"delimiter"}),
    "sort": ({"by"}, {"stable"}),
    "sink": ({"destination"}, {"format", "single", "codec"}),
}


def _names(value: Any, what: str) -> tuple[str, ...]:
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, list) or not all(isinstance(x, (str, int)) for x in value):
        raise ConfigError(f"{what} must be a list of names")
    return tuple(map(str, value))


def _function(raw: Mapping[str, Any]) -> WindowFunction:
    kind, alias = raw.get("type"), raw.get("alias")
    if kind not in KINDS:
        raise unknown("window function", kind, KINDS)
    if not alias:
        raise ConfigError("a window function needs an alias")
    if kind == "sum" and not raw.get("column"):
        raise ConfigError("window sum needs a column")
    frame = raw.get("frame") or {}
    return WindowFunction(kind, alias, raw.get("column"), frame.get("start", "unbounded_preceding"), frame.get("end", "current_row"))


def _field(raw: Any) -> N.Field:
    if not isinstance(raw, Mapping) or "name" not in raw or "type" not in raw:
        raise ConfigError("a schema field needs a name and a type")
    parse_type(raw["type"])
    return N.Field(str(raw["name"]), str(raw["type"]), bool(raw.get("nullable", False)))


def _pairs(value: Any) -> tuple[tuple[str, str], ...]:
    out = []
    for k in value if isinstance(value, list) else [value]:
        if isinstance(k, Mapping):
            k = [k.get("left"), k.get("right")]
        pair = (k, k) if isinstance(k, str) else tuple(k)
        if len(pair) != 2 or not all(isinstance(x, str) for x in pair):
            raise ConfigError("join keys are names or pairs of names")
        out.append(pair)
    return tuple(out)


def _step(raw: Any, inputs: Mapping[str, N.Plan]) -> N.Step:
    if not isinstance(raw, Mapping):
        raise ConfigError("a step must be a mapping with an 'op'")
    raw = {"on" if k is True else k: v for k, v in raw.items()}  # YAML 1.1 reads the word `on` as true
    op = raw.get("op")
    if op is None:
        raise ConfigError("missing field 'op'", hints=[f"known steps: {', '.join(FIELDS)}"])
    if op not in FIELDS:
        raise unknown("step", op, FIELDS)
    needed, allowed = FIELDS[op]
    have = {k: v for k, v in raw.items() if k != "op"}
    for k in needed - have.keys():
        raise ConfigError(f"{op}: missing field '{k}'")
    for k in have.keys() - needed - allowed:
        raise unknown(f"field of {op}", k, sorted(needed | allowed))
    if op == "scan":
        return N.Scan(str(raw["source"]), tuple(_field(f) for f in raw.get("schema") or ()), raw.get("format"))
    if op == "filter":
        return N.Filter(raw.get("expr"))
    if op == "project":
        return N.Project(_names(raw["columns"], "columns"))
    if op == "map":
        return N.Map(str(raw["expr"]))
    if op == "aggregate":
        return N.Aggregate(_names(raw.get("group_by") or [], "group_by"), _names(raw["aggs"], "aggs"))
    if op == "join":
        right = raw["right"]
        if isinstance(right, str):
            if right not in inputs:
                raise unknown("input", right, inputs)
            plan = inputs[right]
        else:
            plan = _plan(right, inputs)
        return N.Join(plan, _pairs(raw["on"]), raw.get("type", "inner"), raw.get("strategy"), bool(raw.get("null_safe", False)))
    if op == "window":
        return N.WindowStep(_names(raw.get("partitions") or [], "partitions"), _names(raw.get("order_by") or [], "order_by"), tuple(_function(f) for f in raw["functions"]))
    if op == "lateral":
        delimiter = raw.get("delimiter")
        return N.Lateral(raw["column"], raw["alias"], "," if delimiter is None else str(delimiter))
    if op == "sort":
        return N.Sort(_names(raw["by"], "by"), bool(raw.get("stable", False)))
    return N.Sink(str(raw["destination"]), raw.get("format", "csv"), bool(raw.get("single", False)), raw.get("codec"))


def _plan(steps: Any, inputs: Mapping[str, N.Plan]) -> N.Plan:
    if not isinstance(steps, list) or not steps:
        raise ConfigError("the pipeline has no steps")
    out = []
    for i, raw in enumerate(steps, 1):
        try:
            out.append(_step(raw, inputs))
        except PipelineError as e:
            raise e.within(f"step {i}")
    return N.Plan(tuple(out))


def parse_yaml(text: str) -> ParsedPipeline:
    """Reads and checks a pipeline; nothing is opened or run."""
    try:
        import yaml
    except ImportError as e:  # not part of every Spark installation
        raise ConfigError("reading YAML pipelines needs PyYAML", hints=["build the pipeline in Python instead"]) from e
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"not valid YAML: {e}") from e
    if not isinstance(raw, Mapping) or "steps" not in raw:
        raise ConfigError("a pipeline needs 'steps'")
    for k in raw.keys() - {"steps", "config", "inputs"}:
        raise unknown("section", k, ("config", "inputs", "steps"))
    inputs: dict[str, N.Plan] = {}
    for name, steps in (raw.get("inputs") or {}).items():
        inputs[name] = _plan(steps, inputs)
    plan = _plan(raw["steps"], inputs)
    check(plan)
    return ParsedPipeline(plan, dict(raw.get("config") or {}))
