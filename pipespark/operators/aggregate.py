"""Grouped aggregation: partial sums on the map side, one shuffle by the group keys."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, unknown
from ..functions.types import is_number
from .relational import col, need

FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def parse_aggregate(spec: str) -> tuple[str, str | None, str]:
    """(function, column, output name) of ``count``, ``sum:c``, ``SUM(c)`` or ``COUNT(*)``, each with ``AS name`` or not."""
    m = re.fullmatch(r"(?is)\s*(\w+)\s*(?::\s*([^()]+?)|\(\s*(.*?)\s*\))?(?:\s+as\s+(\w+))?\s*", spec)
    if not m:
        raise ConfigError(f"can't read aggregate '{spec}'", hints=["write SUM(column), COUNT(*) or sum:column"])
    name, column = m[1].lower(), m[2] or m[3] or None
    if name not in FUNCTIONS:
        raise unknown("aggregate function", m[1], FUNCTIONS)
    column = None if column == "*" else column and column.strip("` ")
    if column is None and name != "count":
        raise ConfigError(f"'{spec}' needs a column")
    return name, column, m[4] or (name if column is None else f"{name}_{column}")


def _measure(df: DataFrame, name: str, column: str | None, out: str) -> Column:
    if column is None:
        return F.count(F.lit(1)).alias(out)
    need(df, column)
    got, kind = FUNCTIONS[name](col(column)), df.schema[column].dataType
    if name in ("sum", "avg") and not is_number(kind):
        raise ConfigError(f"{name} needs a numeric column; '{column}' is {kind.simpleString()}")
    return (got.cast("double") if name != "count" and is_number(kind) else got).alias(out)


def aggregate(df: DataFrame, group_by: Sequence[str], aggs: Sequence[str]) -> DataFrame:
    """The group columns, then one column for each aggregate.

    Nulls are left out of sums, averages and extremes, and are a group of their own as keys.  Sums, averages and extremes
    of numbers are doubles; extremes of other types keep the type.  Without group columns there is one group of all rows.
    """
    need(df, *group_by)
    parsed = [parse_aggregate(a) for a in aggs]
    names = [*group_by, *[p[2] for p in parsed]]
    if len(set(names)) < len(names):
        raise ConfigError("two output columns have one name", hints=["give one of them a name with AS"])
    if not parsed:
        return df.select(*[col(g) for g in group_by]).distinct()
    return df.groupBy(*[col(g) for g in group_by]).agg(*[_measure(df, *p) for p in parsed])
