"""Filter, project and rename."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, missing_column
from ..functions import expr as E


def need(df: DataFrame, *names: str) -> None:
    for n in names:
        if n not in df.columns:
            raise missing_column(n, df.columns)


def col(name: str):
    return F.col(f"`{name}`")


def filter_rows(df: DataFrame, expr: str | None = None, compat: bool = False) -> DataFrame:
    """Rows for which the expression holds; all rows without one.  A condition that is null doesn't hold."""
    return df if not expr or not expr.strip() else df.filter(E.condition(expr, df.schema, compat))


def project(df: DataFrame, columns: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """The named columns in the order given; all for an empty list.  An item may also be ``expression AS name``."""
    out = []
    for item in columns:
        if item in df.columns:
            out.append(col(item))
        elif m := re.fullmatch(r"(?is)\s*(.+?)\s+as\s+`?([\w.]+)`?\s*", item):
            out.append(E.value(m[1], df.schema, compat).alias(m[2]))
        else:
            raise missing_column(item, df.columns)
    return df.select(*out) if out else df


def parse_renames(expr: str) -> dict[str, str]:
    """``old AS new, other`` as {old: new}; names without AS stand for themselves and may be left out."""
    out: dict[str, str] = {}
    for item in filter(None, (x.strip() for x in expr.split(","))):
        m = re.fullmatch(r"(?i)`?([^`]+?)`?(?:\s+as\s+`?([^`\s]+)`?)?", item)
        if not m:
            raise ConfigError(f"can't read rename '{item}'", hints=["write 'old AS new, other'"])
        if m[1] in out:
            raise ConfigError(f"'{m[1]}' is renamed twice")
        out[m[1]] = m[2] or m[1]
    return out


def map_columns(df: DataFrame, renames: Mapping[str, str] | str) -> DataFrame:
    """Renames columns in place; their order and the columns that aren't named stay."""
    renames = parse_renames(renames) if isinstance(renames, str) else dict(renames)
    need(df, *renames)
    names = [renames.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        twice = sorted({n for n in names if names.count(n) > 1})
        raise ConfigError(f"renaming gives two columns of the name {', '.join(twice)}")
    return df.toDF(*names)
