"""Column statistics in one pass, and the selectivities that they suggest."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import missing_column

#: What is assumed where statistics say nothing.
UNKNOWN_EQUALITY, UNKNOWN_RANGE, BOTH_ENDS = 0.01, 0.5, 0.3


@dataclasses.dataclass(frozen=True)
class ColumnStats:
    min: object = None
    max: object = None
    null_count: int = 0
    distinct_count: int | None = None
    total_count: int = 0

    @property
    def non_null_count(self) -> int:
        return self.total_count - self.null_count

    def merge(self, other: ColumnStats) -> ColumnStats:
        """Of the two sets of rows together; distinct counts can't be added up, so there is none."""
        best = lambda f, a, b: b if a is None else a if b is None else f(a, b)
        return ColumnStats(best(min, self.min, other.min), best(max, self.max, other.max), self.null_count + other.null_count, None, self.total_count + other.total_count)

    def equality(self) -> float:
        """Share of rows equal to some value."""
        if not self.non_null_count:
            return 0.0
        return 1 / self.distinct_count if self.distinct_count else UNKNOWN_EQUALITY

    def range(self, low: object = None, high: object = None) -> float:
        """Share of rows from low to high; either may be open.  One open end is interpolated as if values were spread evenly."""
        if not self.non_null_count:
            return 0.0
        if low is None and high is None:
            return 1.0
        if self.min is None or self.max is None:
            return UNKNOWN_RANGE
        try:
            if (low is not None and low > self.max) or (high is not None and high < self.min):
                return 0.0
            if low is not None and high is not None:
                return BOTH_ENDS
            if (low is not None and low <= self.min) or (high is not None and high >= self.max):
                return 1.0
            span = float(self.max) - float(self.min)
            part = float(self.max) - float(low) if high is None else float(high) - float(self.min)
        except (TypeError, ValueError):
            return UNKNOWN_RANGE
        return min(1.0, max(0.0, part / span)) if span > 0 else UNKNOWN_RANGE


def profile(df: DataFrame, columns: Iterable[str] | None = None, approximate: bool = True) -> DataFrame:
    """A row for each column: column, min, max (as text), null_count, distinct_count, total_count.

    All columns share one aggregate over one scan.  Distinct counts are sketches unless ``approximate`` is off.
    """
    names = list(columns or df.columns)
    for n in names:
        if n not in df.columns:
            raise missing_column(n, df.columns)
    count = F.approx_count_distinct if approximate else F.count_distinct
    q = [F.col(f"`{n}`") for n in names]
    one = df.agg(F.count(F.lit(1)).alias("total"), *[x.alias(f"{k}{i}") for i, c in enumerate(q) for k, x in (("lo", F.min(c).cast("string")), ("hi", F.max(c).cast("string")), ("nn", F.count(c)), ("nd", count(c)))])
    rows = [F.struct(F.lit(n).alias("column"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), (F.col("total") - F.col(f"nn{i}")).alias("null_count"), F.col(f"nd{i}").alias("distinct_count"), F.col("total").alias("total_count")) for i, n in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def collect_stats(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, ColumnStats]:
    """Typed statistics of each column on the driver: one row of a fixed width."""
    names = list(columns or df.columns)
    q = [F.col(f"`{n}`") for n in names]
    row = df.agg(F.count(F.lit(1)).alias("total"), *[x.alias(f"{k}{i}") for i, c in enumerate(q) for k, x in (("lo", F.min(c)), ("hi", F.max(c)), ("nn", F.count(c)), ("nd", F.approx_count_distinct(c)))]).first()
    return {n: ColumnStats(row[f"lo{i}"], row[f"hi{i}"], row["total"] - row[f"nn{i}"], row[f"nd{i}"], row["total"]) for i, n in enumerate(names)}
