"""Operators: each is a function from DataFrame to DataFrame."""

from .aggregate import aggregate
from .helpers import concat_columns, hash_partition, number_rows, repartition_by_hash, sort_by_columns
from .join import join, join_hash, join_merge
from .lateral import lateral_explode
from .relational import filter_rows, map_columns, parse_renames, project
from .sort import sort
from .window import WindowFunction, window

__all__ = ["WindowFunction", "aggregate", "concat_columns", "filter_rows", "hash_partition", "join", "join_hash", "join_merge", "lateral_explode", "map_columns", "number_rows", "parse_renames", "project", "repartition_by_hash", "sort", "sort_by_columns", "window"]
