"""Steps of a pipeline.  A plan is a chain of steps; a join holds the plan of its right side."""

from __future__ import annotations

import dataclasses
import json

from ..operators.window import WindowFunction


@dataclasses.dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = False


@dataclasses.dataclass(frozen=True)
class Scan:
    source: str
    schema: tuple[Field, ...] = ()
    format: str | None = None


@dataclasses.dataclass(frozen=True)
class Filter:
    expr: str | None = None


@dataclasses.dataclass(frozen=True)
class Project:
    columns: tuple[str, ...] = ()


@dataclasses.dataclass(frozen=True)
class Map:
    expr: str = ""


@dataclasses.dataclass(frozen=True)
class Aggregate:
    group_by: tuple[str, ...]
    aggs: tuple[str, ...]


@dataclasses.dataclass(frozen=True)
class Join:
    right: Plan
    on: tuple[tuple[str, str], ...]
    type: str = "inner"
    strategy: str | None = None
    null_safe: bool = False


@dataclasses.dataclass(frozen=True)
class WindowStep:
    partitions: tuple[str, ...]
    order_by: tuple[str, ...]
    functions: tuple[WindowFunction, ...]


@dataclasses.dataclass(frozen=True)
class Lateral:
    column: str
    alias: str
    delimiter: str = ","


@dataclasses.dataclass(frozen=True)
class Sort:
    by: tuple[str, ...]
    stable: bool = False


@dataclasses.dataclass(frozen=True)
class Sink:
    destination: str
    format: str = "csv"
    single: bool = False
    codec: str | None = None


Step = Scan | Filter | Project | Map | Aggregate | Join | WindowStep | Lateral | Sort | Sink


@dataclasses.dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]

    def canonical(self) -> str:
        """The plan as JSON of a fixed form, for hashing."""

        def plain(x):
            if dataclasses.is_dataclass(x):
                return {"node": type(x).__name__} | {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
            return [plain(y) for y in x] if isinstance(x, (tuple, list)) else x

        return json.dumps(plain(self), sort_keys=True, separators=(",", ":"))
