"""Global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from .relational import col, need


def sort_keys(df: DataFrame, by: Sequence[str]) -> list:
    """Ascending, nulls first; ``name DESC`` turns a key round (nulls last)."""
    out = []
    for item in by:
        name, _, way = item.rpartition(" ") if item not in df.columns and item.lower().endswith((" asc", " desc")) else (item, "", "asc")
        need(df, name.strip())
        out.append(col(name.strip()).desc_nulls_last() if way.lower() == "desc" else col(name.strip()).asc_nulls_first())
    return out


def sort(df: DataFrame, by: Sequence[str], stable: bool = False) -> DataFrame:
    """All rows in order of the columns, by range partitioning: no task sees more than its range.

    ``stable`` keeps the input's order among ties, as far as the input has one (files read in place).
    """
    if not by:
        raise ConfigError("sort needs at least one column")
    if not stable:
        return df.orderBy(*sort_keys(df, by))
    return df.withColumn("__at", F.monotonically_increasing_id()).orderBy(*sort_keys(df, by), "__at").drop("__at")
