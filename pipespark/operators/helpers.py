"""Helpers on frames: local sort, hash partitions, columns side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..scratch import Workspace
from .join import right_names
from .relational import col, need
from .sort import sort_keys


def sort_by_columns(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each partition in order, without a shuffle."""
    return df.sortWithinPartitions(*sort_keys(df, by))


def hash_partition(df: DataFrame, keys: Sequence[str], n: int, out: str = "partition") -> DataFrame:
    """df with the number (0 to n-1) of each row's partition by the hash of its keys; equal keys, nulls too, share one."""
    if n < 1:
        raise ConfigError("the number of partitions must be positive")
    need(df, *keys)
    return df.withColumn(out, F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(n)).cast("int"))


def repartition_by_hash(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    need(df, *keys)
    return df.repartition(n, *[col(k) for k in keys])


def number_rows(df: DataFrame, out: str = "row") -> DataFrame:
    """df with its rows numbered from 0 in their order.

    The rows are written once with their partition and place in it, so that the number is the rows of earlier partitions,
    one count each, plus the place, and no second run of the plan can deal rows differently.
    """
    at = F.monotonically_increasing_id()
    kept = Workspace(df.sparkSession).keep(df.withColumn("__at", at), "numbered").withColumn("__p", F.shiftright("__at", 33))
    sizes = kept.groupBy("__p").agg(F.count("*").alias("__n"))  # one row for each partition
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(before), "__p").select(*[col(c) for c in df.columns], number.alias(out))


def concat_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of two frames side by side, first with first; the shorter one is filled up with nulls.

    Rows are matched by their place in the input, so both should come from files or from ``orderBy``.
    """
    names = right_names(left.columns, right.columns)
    a = number_rows(left, "__row")
    b = number_rows(right.withColumnsRenamed(names), "__row")
    both = a.join(b, "__row", "full").orderBy("__row")
    return both.select(*[col(c) for c in left.columns], *[col(names[c]) for c in right.columns])
