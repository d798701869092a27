"""Equi-joins with a fixed rule for names: left columns, then right columns, a taken name getting ``_right``."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, unknown
from .relational import need

#: Join types and Spark's names of them.
TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full"}
HINTS = {None: None, "hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}


def right_names(left: Sequence[str], right: Sequence[str]) -> dict[str, str]:
    """The output name of each right column."""
    taken, out = set(left), {}
    for c in right:
        name = c
        while name in taken:
            name += "_right"
        taken.add(name)
        out[c] = name
    return out


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str] | str], how: str = "inner", strategy: str | None = None, null_safe: bool = False) -> DataFrame:
    """Rows of left and right that agree on all pairs of keys; both sides' key columns are kept.

    Spark picks the strategy by size and splits skewed partitions unless ``strategy`` says hash, merge or broadcast; a
    broadcast asked for is the caller's word that the right side is small.  Null keys match nothing, or each other
    with ``null_safe``.
    """
    how = str(how).lower().removesuffix("_outer").removesuffix("outer")
    if how not in TYPES:
        raise unknown("join type", how, TYPES)
    if strategy not in HINTS:
        raise unknown("join strategy", strategy, [h for h in HINTS if h])
    if not on:
        raise ConfigError("join keys are empty", hints=["give at least one pair of columns"])
    keys = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    need(left, *[a for a, _ in keys])
    need(right, *[b for _, b in keys])
    names = right_names(left.columns, right.columns)
    l, r = left.alias("__l"), right.toDF(*[f"__r_{i}" for i in range(len(right.columns))])  # noqa: E741
    of = {c: f"__r_{i}" for i, c in enumerate(right.columns)}
    if HINTS[strategy]:
        r = r.hint(HINTS[strategy])
    same = lambda a, b: a.eqNullSafe(b) if null_safe else a == b
    cond = functools.reduce(lambda x, y: x & y, [same(F.col(f"__l.`{a}`"), F.col(of[b])) for a, b in keys])
    both = l.join(r, cond, TYPES[how])
    return both.select(*[F.col(f"__l.`{c}`") for c in left.columns], *[F.col(of[c]).alias(names[c]) for c in right.columns])


def join_hash(left: DataFrame, right: DataFrame, on, how: str = "inner", **more) -> DataFrame:
    """A shuffled hash join: both sides partitioned by the keys, the right side of each partition hashed."""
    return join(left, right, on, how, "hash", **more)


def join_merge(left: DataFrame, right: DataFrame, on, how: str = "inner", **more) -> DataFrame:
    """A sort-merge join; inputs needn't be sorted."""
    return join(left, right, on, how, "merge", **more)
