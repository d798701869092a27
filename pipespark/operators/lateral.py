"""Lateral explode: a row for each part of a delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from .relational import col, need


def lateral_explode(df: DataFrame, column: str, alias: str, delimiter: str = ",") -> DataFrame:
    """All columns repeated, and one part of the column's text as ``alias``.

    The delimiter is literal text.  Empty parts stay, at the ends too.  Null counts as the empty text, which has one empty
    part.  Values that aren't text are written as text first.  An empty delimiter cuts before and after every character,
    which leaves an empty part at both ends.
    """
    need(df, column)
    if alias in df.columns:
        raise ConfigError(f"column '{alias}' already exists")
    text = F.coalesce(col(column).cast("string"), F.lit(""))
    if delimiter == "":
        letters = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))
        parts = F.concat(F.array(F.lit("")), letters, F.array(F.lit("")))
    else:
        quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        parts = F.split(text, quoted, -1)
    return df.select("*", F.explode(parts).alias(alias))
