"""Windowed row numbers and sums."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, unknown
from ..functions.types import is_number
from ..scratch import Workspace
from .relational import col, need

KINDS = ("row_number", "sum")

#: Ends of a frame of rows.
ENDS = {"unbounded_preceding": Window.unboundedPreceding, "current_row": Window.currentRow}


@dataclasses.dataclass(frozen=True)
class WindowFunction:
    kind: str
    alias: str
    column: str | None = None
    start: str = "unbounded_preceding"
    end: str = "current_row"


def window(df: DataFrame, partitions: Sequence[str], order_by: Sequence[str], functions: Sequence[WindowFunction]) -> DataFrame:
    """df with one more column for each function.

    Order is ascending with nulls first.  Ties, and rows without an order, are taken as they stand in the input, so the
    numbers depend on nothing but it.  A sum is a double over a frame of rows, null counting as 0.  Rows of a partition
    are sorted by one task, which spills; functions of the same partition and order share that sort.  Without partitions the
    rows are sorted by ranges and written, and every range adds what the ranges before it come to.
    """
    need(df, *partitions, *order_by)
    keys = [col(o).asc_nulls_first() for o in order_by]
    rows = df.withColumn("__at", F.monotonically_increasing_id())
    w = Window.partitionBy(*[col(p) for p in partitions]).orderBy(*keys, "__at")
    if not partitions:
        rows = (rows.orderBy(*keys, "__at") if keys else rows).withColumn("__at", F.monotonically_increasing_id())
        rows = Workspace(df.sparkSession).keep(rows, "ordered").withColumn("__range", F.shiftright("__at", 33))
        w = Window.partitionBy("__range").orderBy("__at")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried: dict[str, Column] = {}

    def running(x: Column, alias: str) -> Column:
        inside = F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        if partitions:
            return inside
        carried[alias] = F.sum(x)
        return inside + col(f"__before_{alias}")

    out, taken = [], set(df.columns)
    for f in functions:
        if f.alias in taken:
            raise ConfigError(f"window column '{f.alias}' already exists")
        taken.add(f.alias)
        if f.kind == "row_number":
            number = F.row_number().over(w).cast("bigint")
            out.append((number if partitions else running(F.lit(1).cast("bigint"), f.alias)).alias(f.alias))
        elif f.kind == "sum":
            if not f.column:
                raise ConfigError("window sum needs a column")
            need(df, f.column)
            if not is_number(df.schema[f.column].dataType):
                raise ConfigError(f"window sum needs a numeric column; '{f.column}' is {df.schema[f.column].dataType.simpleString()}")
            if f.start not in ENDS or f.end not in ENDS:
                raise unknown("frame end", f.start if f.start not in ENDS else f.end, ENDS)
            x = F.coalesce(col(f.column).cast("double"), F.lit(0.0))
            if f.start == f.end == "current_row":
                out.append(x.alias(f.alias))
            elif f.end == "unbounded_preceding":
                raise ConfigError("a frame can't end at unbounded_preceding")
            else:
                out.append(running(x, f.alias).alias(f.alias))
        else:
            raise unknown("window function", f.kind, KINDS)
    if carried:
        totals = rows.groupBy("__range").agg(*[x.alias(f"__sum_{a}") for a, x in carried.items()])
        starts = totals.select("__range", *[F.coalesce(F.sum(f"`__sum_{a}`").over(before), F.lit(0)).alias(f"__before_{a}") for a in carried])
        rows = rows.join(F.broadcast(starts), "__range")
    return rows.select(*[col(c) for c in df.columns], *out)
